"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The words of the whole corpus are counted; the frequent ones are merged once, on the driver, and compiled into the
minimal acyclic automaton of their bytes (equal suffixes share states). Each edge carries how many words sort before
those behind it, so the walk over a word adds up to its number, and the number's ids are its output. The automaton is
one block of bytes: it is broadcast (its size is bounded by the number of words), and each Python worker maps it from
a file that is unlinked at once. Words that aren't in the lexicon are merged by the exact rules: always the pair of
the lowest rank, the leftmost first.

A task remembers what the last distinct words came to, so the automaton is asked, or an unseen word merged, when a task meets
a word for the first time; words of the lexicon are never forgotten, others all at once when there are too many.

Text is treated as the tokenizer file says: special tokens first, then NFC, white space, lower case (per character),
the splitting pattern, and UTF-8 bytes as printable characters. Without a decoder in the file, decoding joins the
tokens by spaces.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import struct
import tempfile
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlight.llm.common import slices, tidied
from arborlight.plans.durable import Scratch

#: White space as the tokenizer's expressions take it (without U+001C to U+001F).
_WS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_WS}\p{{L}}\p{{N}}]+")

#: Characters below U+0250, but for fractions and raised digits, and common marks: of these no two compose, a letter is what str.isalpha() takes for one.
_UNPLAIN = re.compile("[\u00b2\u00b3\u00b9\u00bc-\u00be\u0250-\u200f\u2028-\u202f\u205f-\U0010ffff]")
#: Longer words aren't remembered.
_LONG = 64
_SPLIT_PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w{_WS}]|_)+")

#: Letters and numbers of a later Unicode version than the tokenizer's: symbols to it. Texts with one are split apart.
_LATE = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a "
    "11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 "
    "18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 "
    "1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
_LATE = "".join("-".join(rf"\U{int(x, 16):08x}" for x in part.split("-")) for part in _LATE.split())
#: Lower case that Python's tables lack.
_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_RARE = regex.compile("[" + _LATE + "".join(map(chr, _LOWER)) + "]")
_SPLIT_RARE = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_LATE}]]+|[\p{{N}}--[{_LATE}]]|[[^{_WS}\p{{L}}\p{{N}}]||[{_LATE}]]+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def lower(text: str) -> str:
    """Lower case of each character for itself: a final sigma is as any sigma."""
    return text.lower() if "Σ" not in text else text.replace("Σ", "σ").lower()


class Vocabulary:
    """Token ids and merge ranks of a tokenizer file; merges words exactly."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.tokens = [""] * size
        for t, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = t
        self.shift = size
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[self.ids[a] * size + self.ids[b]] = r
            self.merged.append(self.ids[a + b])
        chars = byte_characters()
        self.inner = [self.ids[c] for c in chars]
        self.final = [self.ids[c + self.suffix] for c in chars]
        self.splitter = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        # A byte that continues a character can end no word, but the tokenizer suffixes characters, which are bytes here.

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: the pair of the lowest rank is merged, leftmost first, until none is left."""
        parts = [self.inner[b] for b in word[:-1]]
        parts.append(self.final[word[-1]])
        return self._merge_long(parts) if len(parts) > 64 else self._merge_short(parts)

    def _merge_short(self, parts: list[int]) -> list[int]:
        get, size, merged, none = self.rank.get, self.shift, self.merged, 1 << 30
        ranks = [get(a * size + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        n = len(ranks)
        while n:
            r = min(ranks)
            if r == none:
                break
            i = ranks.index(r)
            m = parts[i] = merged[r]
            del parts[i + 1], ranks[i]
            n -= 1
            if i:
                ranks[i - 1] = get(parts[i - 1] * size + m, none)
            if i < n:
                ranks[i] = get(m * size + parts[i + 1], none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same by a queue over a linked list, for words of any length."""
        get, size, n = self.rank.get, self.shift, len(parts)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] * size + parts[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = nxt[i] if parts[i] >= 0 else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = self.merged[r], -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for left in (prv[i], i):
                if left >= 0 and (right := nxt[left]) < n and (q := get(parts[left] * size + parts[right])) is not None:
                    heapq.heappush(queue, (q, left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def segments(self, text: str):
        """Words of a text as lists, and ids of special tokens between them."""
        if self.splitter is None or "<|" not in text:
            yield words(text)
            return
        at = 0
        for m in self.splitter.finditer(text):
            yield words(text[at : m.start()])
            yield self.special[m[0]]
            at = m.end()
        yield words(text[at:])


def words(text: str) -> list[str]:
    """Words of a text without special tokens: NFC, lower case, the splitting pattern."""
    if text.isascii() or not _UNPLAIN.search(text):
        return _SPLIT_PLAIN.findall(text.lower())
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if _RARE.search(text):
            return _SPLIT_RARE.findall(lower(text.translate(_LOWER)))
    return _SPLIT.findall(lower(text))


class Lexicon:
    """The minimal acyclic automaton of sorted words, and the ids that each word puts out; read from one block of bytes.

    Header: counts of states, edges, words and ids. Then for each state its first edge and whether a word ends there;
    for each edge the label, the target and the number of words before; for each word its first id; the ids.
    """

    _HEAD = struct.Struct("<4I")

    @staticmethod
    def compile(entries: list[tuple[bytes, list[int]]]) -> bytes:
        """From distinct words in ascending order, with their ids."""
        # States under construction: (is final, [(label, state)]); finished ones are shared by signature.
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []
        path: list[list] = [[False, []]]
        previous = b""

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        for word, _ in entries:
            common = 0
            while common < min(len(word), len(previous)) and word[common] == previous[common]:
                common += 1
            for i in range(len(previous), common, -1):
                done = freeze(path.pop())
                path[-1][1].append((previous[i - 1], done))
            path.extend([False, []] for _ in word[common:])
            path[-1][0] = True
            previous = word
        for i in range(len(previous), 0, -1):
            done = freeze(path.pop())
            path[-1][1].append((previous[i - 1], done))
        root = freeze(path[0])
        count = []
        for final, edges in states:  # targets come before their sources
            count.append(int(final) + sum(count[t] for _, t in edges))
        first, label, target, skip = [0], [], [], []
        for final, edges in states:
            before = int(final)
            for c, t in edges:
                label.append(c)
                target.append(t)
                skip.append(before)
                before += count[t]
            first.append(len(label))
        starts = np.concatenate([[0], np.cumsum([len(x) for _, x in entries], dtype=np.int64)]) if entries else np.zeros(1)
        ids = [i for _, x in entries for i in x]
        arrays = [np.array(first, "<u4"), np.array(target, "<u4"), np.array(skip, "<u4"), starts.astype("<u4"), np.array(ids, "<u4"), np.array([f for f, _ in states], "u1"), np.array(label, "u1")]
        return Lexicon._HEAD.pack(len(states), len(label), len(entries), len(ids)) + struct.pack("<I", root) + b"".join(a.tobytes() for a in arrays)

    def __init__(self, block):
        view = memoryview(block)
        n, e, w, k = self._HEAD.unpack_from(view)
        (self.root,) = struct.unpack_from("<I", view, 16)
        at = 20

        def take(count: int, kind: str):
            nonlocal at
            size = 4 if kind == "I" else 1
            out = view[at : at + count * size].cast(kind)
            at += count * size
            return out

        self.first, self.target, self.skip, self.start, self.ids = take(n + 1, "I"), take(e, "I"), take(e, "I"), take(w + 1, "I"), take(k, "I")
        self.final, self.label = take(n, "B"), bytes(take(e, "B"))

    @classmethod
    def mapped(cls, block: bytes) -> Lexicon:
        """From a memory map of an unlinked file: pages are shared with the system's cache and can be dropped."""
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def get(self, word: bytes) -> list[int] | None:
        state, number = self.root, 0
        first, label, target, skip = self.first, self.label, self.target, self.skip
        for c in word:
            e = label.find(c, first[state], first[state + 1])
            if e < 0:
                return None
            number += skip[e]
            state = target[e]
        return self.ids[self.start[number] : self.start[number + 1]].tolist() if self.final[state] else None


class _Words(dict):
    """Word -> (its ids, its tokens), each joined by spaces. With more than ``most`` words, all that aren't in the lexicon are forgotten."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon, most: int):
        super().__init__()
        self.v, self.lexicon, self.most = vocabulary, lexicon, most
        self.names = list(map(str, range(len(vocabulary.tokens))))
        self.frequent: dict[str, tuple[str, str]] = {}

    def __missing__(self, word: str) -> tuple[str, str]:
        data = word.encode("utf-8", "surrogatepass")
        known = self.lexicon.get(data)
        ids = known or self.v.merge(data)
        out = (" ".join([self.names[i] for i in ids]), " ".join([self.v.tokens[i] for i in ids]))
        if len(self) >= self.most:
            self.clear()
            self.update(self.frequent)
        if known:
            self.frequent[word] = out
        if len(word) <= _LONG:
            self[word] = out
        return out


class Codec:
    """Encodes and decodes whole texts; remembers at most ``most`` words besides those of the lexicon."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon, most: int = 200_000):
        self.v, self.words = vocabulary, _Words(vocabulary, lexicon, most)

    def encode(self, text: str | None) -> tuple[str, str]:
        """(ids joined by spaces, decoded text)."""
        ids: list[str] = []
        out: list[str] = []
        get = self.words.__getitem__
        for part in self.v.segments(text or ""):
            if isinstance(part, int):
                ids.append(str(part))
                out.append(self.v.tokens[part])
            elif part:
                i, o = zip(*map(get, part), strict=True)
                ids += i
                out += o
        return " ".join(ids), " ".join(out)

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.v.tokens[i] for i in ids if 0 <= i < len(self.v.tokens) and self.v.tokens[i]])


def frequent_words(docs: DataFrame, scratch: Scratch, spec: dict, text_col: str, most: int, held: int = 300_000) -> list[tuple[bytes, list[int]]]:
    """The most frequent words of all texts, with their ids; fewer than ``most``, as counts at the border tie.

    Counted in tasks, which hold ``held`` distinct words at most before they hand their counts on; then by the cluster. The least
    count that enough words have comes from the counts' histogram.
    """

    def count(batches):
        v = Vocabulary(spec)
        seen: Counter[str] = Counter()

        def counts():
            total = {w: c for w, c in seen.items() if len(w) <= 40 and w.isprintable()}  # others are merged as they come
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for x in batch.column(0):
                for part in v.segments(x.as_py() or ""):
                    if not isinstance(part, int):
                        seen.update(part)
                if len(seen) >= held:
                    yield counts()
        yield counts()

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(tidied(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = scratch.save(counts)
    tops = counts.groupBy(F.least("n", F.lit(1_000_000)).alias("n")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n"))
    total, least = 0, None
    for row in tops.toLocalIterator():
        if total + row.words > most:
            break
        total, least = total + row.words, row.n
    if least is None:
        return []
    v = Vocabulary(spec)
    found = sorted(r.word.encode() for r in counts.where(F.col("n") >= least).select("word").toLocalIterator())
    return [(w, v.merge(w)) for w in found]


def encode_documents(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = 100_000, keep_tokens: bool = False,
) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256; with keep_tokens also ids and decoded.

    Null and empty texts have no tokens and decode to the empty text. Texts of any length are encoded whole. Repeated rows
    give repeated results, empty tables empty ones; other columns are not read. The vocabulary file is read on the
    driver alone and sent to the executors.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "bpe")
    with open(vocabulary_path, encoding="utf-8") as f:
        spec = json.load(f)
    spec = {"added_tokens": spec["added_tokens"], "model": {k: spec["model"][k] for k in ("vocab", "merges", "end_of_word_suffix")}}
    sent_spec = spark.sparkContext.broadcast(spec)  # bounded by the vocabulary file
    lexicon = Lexicon.compile(frequent_words(docs, scratch, spec, text_col, lexicon_words))
    sent = spark.sparkContext.broadcast(lexicon)  # bounded by lexicon_words of at most 160 bytes
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    fields = [("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if keep_tokens:
        kind += ", ids array<int>, decoded string"
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
    schema = pa.schema(fields)

    def encode(batches):
        codec = Codec(Vocabulary(sent_spec.value), Lexicon.mapped(sent.value))
        for batch in slices(batches):
            done = [codec.encode(x.as_py()) for x in batch.column(1)]
            columns = {
                "id": batch.column(0), "n_tokens": [i.count(" ") + 1 if i else 0 for i, _ in done],
                "ids_sha256": [hashlib.sha256(i.encode()).hexdigest() for i, _ in done],
                "decoded_sha256": [hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for _, d in done],
            }
            if keep_tokens:
                columns |= {"ids": [list(map(int, i.split())) for i, _ in done], "decoded": [d for _, d in done]}
            yield pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidied(encode), f"id long, {kind}")
    return out.withColumnRenamed("id", id_col)
