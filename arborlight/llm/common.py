"""Pieces that several operators share: words as bytes, streamed groups, bounded bit tables."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ALL = bytes(range(256))
#: A-Z to a-z, all other bytes as they are. Words split at white space are then bytes.split().
LOWER = _ALL.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
#: As LOWER, with each ASCII byte that is neither letter nor digit made a space.
LOWER_ALNUM = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in LOWER)

SPACE_WORD = r"[^\x20\x09-\x0D]+"


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def alnum_words(text: str | None) -> list[bytes]:
    """Words of ASCII letters, digits and non-ASCII characters, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_ALNUM).split()


class HashCache(dict):
    """64-bit hashes of words, as 8 bytes each; forgets all when it holds too many."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_digest(word)
        return h


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(words: list[bytes], k: int, cache: HashCache) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words make one shingle, none make none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map(cache.__getitem__, words)), np.uint64)
    width = min(k, n)
    acc = h[: n - width + 1].copy()
    for j in range(1, width):
        acc = acc * _P + h[j : n - width + 1 + j]
    acc = mix64(acc + np.uint64(width))
    acc.sort()
    return acc[np.concatenate(([True], acc[1:] != acc[:-1]))]


def arrow_out(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, as what a task makes of a text can be several times its size."""
    for b in batches:
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)


def tidied(fn):
    """fn, an iterator over batches, and then what it has freed goes back to the system: workers are used again, and wait with what they hold."""

    def run(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def stream_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows of one key each, from batches sorted by the keys; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[s] for c in cols)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def grouped_arrow(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """fn(iterator of groups' tables) -> iterator of batches, over groups dealt out by their keys.

    As a grouped map, but many small groups share one batch, and a task holds one group at a time.
    """

    def run(batches):
        return fn(stream_groups(batches, keys))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidied(run), schema)


class Union:
    """Union-find over 0..n-1 with path halving; the least index is the root."""

    def __init__(self, n: int):
        self.p = list(range(n))

    def find(self, i: int) -> int:
        p = self.p
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.p[max(i, j)] = min(i, j)
        return True


def bloom_words(ids: Column, bits: int, hashes: int = 3) -> Column:
    """array<struct(slot, mask)>: the 64-bit words, and bits in them, that an id sets in a filter of ``bits`` bits."""
    out = []
    for i in range(hashes):
        pos = F.pmod(F.xxhash64(ids, F.lit(i)), F.lit(bits))
        out.append(F.struct(F.shiftright(pos, 6).cast("int").alias("slot"), F.expr("1L").alias("one"), F.pmod(pos, F.lit(64)).cast("int").alias("bit")))
    return F.array(*out)


def bloom_filter(df: DataFrame, id_col: str, bits: int = 1 << 23) -> np.ndarray:
    """A Bloom filter of the ids, built where they are; at most bits/64 words come to the driver."""
    words = (
        df.select(F.explode(bloom_words(F.col(id_col), bits)).alias("w"))
        .groupBy("w.slot")
        .agg(F.bit_or(F.expr("shiftleft(w.one, w.bit)")).alias("mask"))
    )
    out = np.zeros(bits // 64, np.int64)
    rows = words.toPandas()
    out[rows["slot"].to_numpy(int)] = rows["mask"].to_numpy(np.int64)
    return out


def bloom_has(df: DataFrame, id_col: str, words: np.ndarray, hashes: int = 3, keep: bool = True, then=None, schema=None) -> DataFrame:
    """Rows whose id may be in the filter (with keep=False: those whose id can't be, or is null); tells it by the same hashes, in the JVM, and looks up in Arrow batches.

    ``then`` maps the batches of these rows on, in the same worker, to batches of ``schema``.
    """
    bits, names = len(words) * 64, df.columns
    bc = df.sparkSession.sparkContext.broadcast(words.view(np.uint64))
    named = df.select("*", *[F.pmod(F.xxhash64(F.col(id_col), F.lit(i)), F.lit(bits)).alias(f"_h{i}") for i in range(hashes)], F.col(id_col).isNull().alias("_null"))

    def passed(batches):
        table = bc.value
        for b in batches:
            may = ~np.asarray(b.column("_null").to_numpy(zero_copy_only=False), bool)
            for i in range(hashes):
                p = b.column(f"_h{i}").to_numpy(zero_copy_only=False).astype(np.uint64)
                may &= (table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) > 0
            yield b.filter(pa.array(may if keep else ~may)).select(names)

    def run(batches):
        return then(passed(batches)) if then else passed(batches)

    return named.mapInArrow(tidied(run), schema or df.schema)
