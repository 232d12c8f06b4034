"""Language identification by bit-sliced Bloom filters of character n-grams.

Each language has a Bloom filter of all n-grams that its texts contain, and further ones (planes) of those that it uses at
least PLANES[k] times as often as the language that uses them most. The filters are sliced by position, so one slot
holds the bits of all languages, and the bitwise and of an n-gram's slots names every language that contains it, and
how much it is at home in each. A text's n-grams are looked up in one go; each language's bits are counted plane by
plane, and the false positives that a filter is expected to give are taken out. The sum over the planes is a
log-likelihood in steps of the planes' ratio; the language with the greatest sum is the answer.

Texts are cut into runs of bounded length for counting and for look-up, so memory depends neither on the length of a text
nor on the size of an Arrow batch.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlight.llm.common import mix64, tidied
from arborlight.plans.durable import Scratch

UNKNOWN = "und"
#: Shares of the greatest relative frequency from which on an n-gram is in a language's plane; the first plane holds all.
PLANES = (0.0, 1 / 64, 1 / 8, 1 / 2)
#: A filter gets as many slots as keep the share of set bits of each language to FILL, up to 2^MOST_BITS; past FULL it tells nothing.
FILL, FULL, MOST_BITS = 0.25, 0.95, 24
#: Characters of a run, and n-grams that a task holds before it hands their counts on.
RUN, HELD = 1 << 18, 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_LETTERS: list[np.ndarray] = []
_BITS = (np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def gram_runs(text: str | None, n: int, run: int = RUN):
    """Hashes of the n-grams of the text's letters in lower case, all else being one space; in arrays of bounded length. None for texts without a letter."""
    text = text or ""
    held, before, any_letter, any_gram = np.zeros(1, np.uint64), np.uint64(0), False, False
    for s in range(0, len(text), run):
        codes = np.frombuffer(text[s : s + run].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(_letters()[codes], codes, 0)
        any_letter = any_letter or bool(codes.any())
        last = s + run >= len(text)
        codes = np.concatenate([[before], codes, np.zeros(int(last), np.uint64)]).astype(np.uint64)
        before = codes[-1]
        codes = np.concatenate([held, codes[1:][(codes[1:] != 0) | (codes[:-1] != 0)]])
        if last and any_letter and not any_gram and len(codes) < n:
            codes = np.concatenate([codes, np.zeros(n - len(codes), np.uint64)])
        held = codes[max(0, len(codes) - n + 1) :] if len(codes) >= n else codes
        if len(codes) >= n and not any_letter:
            held = codes
        elif len(codes) >= n:
            any_gram = True
            acc = codes[: len(codes) - n + 1].copy()
            for j in range(1, n):
                acc = acc * _P + codes[j : len(codes) - n + 1 + j]
            yield mix64(acc)


def ngrams(text: str | None, n: int) -> np.ndarray | None:
    """All n-grams of a text as one array; None without a letter."""
    parts = list(gram_runs(text, n))
    return np.concatenate(parts) if parts else None


def slots(grams: np.ndarray, size: int, hashes: int) -> list[np.ndarray]:
    mask = np.uint64(size - 1)
    return [((grams >> np.uint64(21 * i)) & mask).astype(np.int64) for i in range(hashes)]


class LanguageFilter:
    """table[word, slot]: the planes' bits of as many languages as fit into 63 bits in each word; languages in order of their n-grams, most first."""

    def __init__(self, languages: list[str], table: np.ndarray, n: int, hashes: int, planes: int = 1):
        self.languages, self.table, self.n, self.hashes, self.planes = languages, table, n, hashes, planes
        per = 63 // planes
        self.at = [(i // per, i % per * planes + k) for i in range(len(languages)) for k in range(planes)]
        #: Of each language's planes, the share of false positives.
        self.false = np.array([np.count_nonzero(table[w] >> b & 1) / table.shape[1] for w, b in self.at], float) ** hashes

    def popcounts(self, grams: np.ndarray) -> np.ndarray:
        """How many of the n-grams are in each plane of each language."""
        at = slots(grams, self.table.shape[1], self.hashes)
        words = []
        for row in self.table:
            found = row[at[0]]
            for s in at[1:]:
                found = found & row[s]
            limbs = found.view(np.uint8).reshape(-1, 8)
            words.append(np.concatenate([np.bincount(limbs[:, k], minlength=256) @ _BITS for k in range(8)]))
        return np.array([words[w][b] for w, b in self.at], float)

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language contains."""
        return self.popcounts(grams)[:: self.planes]

    def containing(self, gram: np.ndarray) -> list[str]:
        """All languages whose filter holds the n-gram (an array of one)."""
        return [lang for lang, h in zip(self.languages, self.hits(gram), strict=True) if h]

    def decide(self, text: str | None) -> tuple[str, float]:
        """(language, its share of all languages' hits in the last plane), both corrected for false positives."""
        count, n = np.zeros(len(self.at)), 0
        for grams in gram_runs(text, self.n):
            count += self.popcounts(grams)
            n += len(grams)
        if not n or not self.languages:
            return UNKNOWN, 0.0
        true = np.clip((count - n * self.false) / (1 - np.minimum(self.false, 0.999)), 0, None).reshape(-1, self.planes)
        home = true[:, -1]
        best = int(np.argmax(true.sum(axis=1)))
        return self.languages[best], float(home[best] / home.sum()) if home.sum() > 0 else 0.0


def fitting_bits(most: int, bits: int, hashes: int) -> int:
    """The least number of slot bits, from ``bits`` on, at which so many n-grams fill a share of FILL at most."""
    fill = lambda b: 1 - math.exp(-hashes * most / (1 << b))
    while bits < MOST_BITS and fill(bits) > FILL:
        bits += 1
    if fill(bits) > FULL:
        raise ValueError(f"{most} n-grams of a language would fill {fill(bits):.0%} of 2^{bits} slots; use shorter ones")
    return bits


def learn_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", n: int = 4, slot_bits: int = 20, hashes: int = 2) -> LanguageFilter:
    """From all n-grams of all rows whose language isn't null.

    Counts are summed by the cluster; a task holds HELD n-grams at most before it hands their counts on. There are 2^slot_bits
    slots, or as many more as the language with most n-grams needs (see FILL), 2^MOST_BITS at most, and no more come to
    the driver. Fuller filters have more false positives, which the decision takes out; ValueError where even the
    greatest would be fuller than FULL. Null texts and texts without letters teach nothing; without rows no language is learnt.
    """

    def count(batches):
        held: dict[str, list] = {}
        size = 0

        def counts():
            for lang, parts in held.items():
                g, c = np.unique(np.concatenate(parts), return_counts=True)
                for s in range(0, len(g), 1 << 17):
                    part = slice(s, s + (1 << 17))
                    names = pa.DictionaryArray.from_arrays(np.zeros(len(g[part]), np.int32), pa.array([lang], pa.string())).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([names, pa.array(g[part].view(np.int64)), pa.array(c[part].astype(np.int64))], ["lang", "gram", "c"])
            held.clear()

        for b in batches:
            for lang, x in zip(b.column(0), b.column(1), strict=True):
                for g in gram_runs(x.as_py(), n):
                    held.setdefault(lang.as_py(), []).append(g)
                    size += len(g)
                    if size >= HELD:
                        yield from counts()
                        size = 0
        yield from counts()

    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = known.mapInArrow(tidied(count), "lang string, gram long, c long").groupBy("gram", "lang").agg(F.sum("c").alias("c"))
    counts = Scratch(docs.sparkSession, "langid").save(counts)
    totals = counts.groupBy("lang").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("grams")).orderBy(F.desc("total"), "lang").collect()  # a row for each language
    languages, planes = [r.lang for r in totals], len(PLANES)
    if not languages:
        return LanguageFilter([], np.zeros((1, 1 << slot_bits), np.int64), n, hashes)
    number = docs.sparkSession.createDataFrame([(r.lang, i, float(r.total)) for i, r in enumerate(totals)], "lang string, number int, total double")
    rated = counts.join(F.broadcast(number), "lang").select("gram", "number", (F.col("c") / F.col("total")).alias("f"))
    sums = rated.groupBy("gram").agg(F.max("f").alias("most"), F.collect_list(F.struct("number", "f")).alias("in"))  # as many as languages
    held = sums.select("gram", "most", F.inline("in"))
    top = sum((F.when(F.col("f") >= p * F.col("most"), 1).otherwise(0) for p in PLANES[1:]), F.lit(1))
    per = 63 // planes
    size = 1 << fitting_bits(max(r.grams for r in totals), slot_bits, hashes)
    at = F.explode(F.array(*[F.shiftrightunsigned("gram", 21 * i).bitwiseAND(F.lit(size - 1)).cast("int") for i in range(hashes)]))
    held = held.select("gram", "number", top.alias("top"))
    bits = held.select(F.expr(f"cast(number div {per} as int)").alias("w"), F.expr(f"shiftleft(shiftleft(1L, top) - 1, number % {per} * {planes})").alias("m"), at.alias("slot"))
    rows = bits.groupBy("w", "slot").agg(F.bit_or("m").alias("m")).toArrow()
    table = np.zeros((-(-len(languages) // per), size), np.int64)
    table[rows.column("w").to_numpy(), rows.column("slot").to_numpy()] = rows.column("m").to_numpy()
    return LanguageFilter(languages, table, n, hashes, planes)


def with_language(docs: DataFrame, learnt: LanguageFilter, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score, which replace columns of these names.

    'und' with score 0 for null texts, and for those without a letter or a learnt language; letters without a hit give the
    language with most n-grams and score 0. Texts are read whole, repeated rows give repeated results, empty tables empty ones.
    """
    sent = docs.sparkSession.sparkContext.broadcast((learnt.languages, learnt.table, learnt.n, learnt.hashes, learnt.planes))  # bounded by the slots
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "lang_score")])
    names = kept.columns
    schema = kept.withColumns({"lang_pred": F.lit("").cast("string"), "lang_score": F.lit(0.0)}).schema

    def run(batches):
        f = LanguageFilter(*sent.value)
        for whole in batches:
            for s in range(0, whole.num_rows, 1000):
                b = whole.slice(s, 1000)
                got = [f.decide(x.as_py()) for x in b.column(names.index(text_col))]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*names, "lang_pred", "lang_score"])

    return kept.mapInArrow(tidied(run), schema)


def identify(docs: DataFrame, learnt: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score. See with_language; other columns are not read."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return with_language(source, learnt).select(F.col("id").alias(id_col), "lang_pred", F.col("lang_score").alias("score"))
