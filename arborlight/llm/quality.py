"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled good; unlabelled is all text that may be learnt from, labelled or not. For the
logistic loss l and a linear score z the non-negative unbiased risk is
    prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]),
which, as l(z) - l(-z) = -z, is convex as long as the negatives' part isn't clipped. It is minimised by Newton steps; a
step that would make the negatives' part negative (the sign of overfitting) is halved. The prior is estimated from the
same data: positives fill no more of any region than the text as a whole, so it is at most P_u(A) / P_p(A) for each
region A; the least ratio over the upper sets of a first score is taken.

Features come from whole texts: shares of characters of each kind, of words and lines with some property, and hashed words
and character trigrams. Each Newton step sums gradient and Hessian where the features are.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlight.llm.common import LOWER, slices
from arborlight.plans.durable import Scratch

#: Kinds of bytes: capitals, small letters, digits, line ends, other controls and white space, bytes of non-ASCII characters, each ASCII mark.
_GROUPS = [bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b"\n", bytes(i for i in [*range(33), 127] if i != 10), bytes(range(128, 256))]
_GROUPS += [bytes([i]) for i in range(33, 127) if not chr(i).isalnum()]
_MAP = np.zeros(256, np.intp)
for _i, _g in enumerate(_GROUPS):
    _MAP[list(_g)] = _i
_MARKS = set(bytes(i for i in range(33, 127) if not chr(i).isalnum()))
#: Buckets for hashed words and for hashed character trigrams.
HASHED = 32


class _WordBucket(dict):
    """Hash bucket of a word; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        b = self[word] = zlib.crc32(word) % HASHED
        return b


_BUCKET = _WordBucket()


def _steps(x: float, edges: tuple[float, ...]) -> list[float]:
    """One for each edge that x reaches: a curve of steps for a linear score."""
    return [float(x >= e) for e in edges]


def features(text: str | None) -> np.ndarray:
    """Shares of characters, words, lines and n-grams of the whole text, all between 0 and about 1; the last but one tells empty texts, the last is the constant."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return np.concatenate([np.zeros(SIZE - 2), [1.0, 1.0]]).astype(np.float32)
    raw = np.frombuffer(data, np.uint8)
    shares = np.bincount(_MAP, weights=np.bincount(raw, minlength=256), minlength=len(_GROUPS)) / n
    words = data.split()
    lines = [x for x in data.split(b"\n") if x]
    m = max(1, len(words))
    twice = (sum(map(len, lines)) - sum(map(len, set(lines)))) / n
    small = data.translate(LOWER)
    distinct = len(set(small.split())) / m
    capitals = sum(w.isupper() and len(w) > 1 for w in words) / m
    ends = sum(w[-1] in _MARKS for w in words) / m
    extra = [
        np.sqrt(capitals), np.sqrt(ends), np.sqrt(twice), distinct, min(1, n / m / 20), np.log1p(m) / 10, len(lines) / m, np.sqrt(shares[6:].sum()),
        *_steps(capitals, (0.01, 0.1)), *_steps(twice, (0.01, 0.1, 0.3)), *_steps(distinct, (0.25, 0.5, 0.75)), *_steps(n / m, (5, 8, 12)), *_steps(m, (5, 20, 80, 320)), *_steps(shares[6:].sum(), (0.02, 0.05, 0.1)),
    ]
    by_word = np.bincount([_BUCKET[w] for w in small.split()], minlength=HASHED) / m
    codes = np.frombuffer(small, np.uint8).astype(np.uint32)
    grams = (codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA77) ^ codes[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(27)
    by_gram = np.bincount(grams, minlength=HASHED) / max(1, n - 2)
    return np.concatenate([np.sqrt(shares), shares[6:] > 0.002, np.asarray(extra, float), np.sqrt(by_word), np.sqrt(by_gram), [0.0, 1.0]]).astype(np.float32)


SIZE = 2 * len(_GROUPS) - 6 + 26 + 2 * HASHED + 2


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sums(table: DataFrame, fn, size: int) -> np.ndarray:
    """The sum over all rows of fn(features, is positive) -> vector: batches, then 16 tasks, then the driver."""
    kind = pa.schema([("s", pa.binary())])

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column("x").flatten(), np.float32).reshape(b.num_rows, -1).astype(float)
                total += fn(x, b.column("positive").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], schema=kind)

    def add(batches):
        total = np.zeros(size)
        for b in batches:
            for s in b.column(0):
                total += np.frombuffer(s.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], schema=kind)

    rows = table.select("x", "positive").mapInArrow(run, "s binary").repartition(16).mapInArrow(add, "s binary").collect()
    return sum((np.frombuffer(bytes(r.s)) for r in rows), np.zeros(size))


def fit(table: DataFrame, prior: float | None = None, l2: float = 1e-4, spread: float = 30.0, steps: int = 10, bins: int = 400) -> tuple[np.ndarray, float]:
    """(weights, prior) of a table (x, positive). Without positives, or rows, the weights are 0."""
    d = SIZE

    def first(x, p):
        return np.concatenate([[len(x), p.sum()], x[p].sum(0), x.sum(0), (x**2).sum(0)])

    s = _sums(table, first, 2 + 3 * d)
    n, n_p = s[0], s[1]
    if n == 0 or n_p == 0:
        return np.zeros(d), prior or 0.5
    l2 = l2 + spread / n_p  # few positives say little about many features
    mean_p, mean, var = s[2 : 2 + d] / n_p, s[2 + d : 2 + 2 * d] / n, None
    var = np.maximum(s[2 + 2 * d :] / n - mean**2, 0)
    scale = np.where(var > 1e-10, 1 / np.sqrt(np.maximum(var, 1e-10)), 0)
    shift = mean * scale
    scale[-1], shift[-1] = 1, 0
    mu = mean_p * scale - shift

    def newton(w, pi, count):
        def part(w):
            def one(x, p):
                x = x * scale - shift
                z = x @ w
                q = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
                return np.concatenate([[_softplus(z).sum(), _softplus(z[p]).sum()], q @ x, ((x * (q * (1 - q))[:, None]).T @ x).ravel()])

            return _sums(table, one, 2 + d + d * d)

        def risk(s, w):
            negative = s[0] / n - pi * s[1] / n_p  # E_u[l(-z)] - prior * E_p[l(-z)]
            positive = pi * (s[1] / n_p - mu @ w)
            return positive + max(0.0, negative) + l2 / 2 * (w @ w), negative

        s = part(w)
        now, _ = risk(s, w)
        for _ in range(count):
            grad = s[2 : 2 + d] / n - pi * mu + l2 * w
            hess = s[2 + d :].reshape(d, d) / n + l2 * np.eye(d)
            move = np.linalg.solve(hess, grad)
            for _ in range(5):
                tried = w - move
                s2 = part(tried)
                then, negative = risk(s2, tried)
                if then < now and negative >= 0:
                    break
                move = move / 4
            else:
                return w
            gain, w, s, now = now - then, tried, s2, then
            if gain < 1e-4:
                break
        return w

    def estimate(w):
        def histogram(x, p):
            z = np.clip(((x * scale - shift) @ w + 10) / 20 * bins, 0, bins - 1).astype(int)
            return np.concatenate([np.bincount(z, minlength=bins), np.bincount(z[p], minlength=bins)])

        h = _sums(table, histogram, 2 * bins)
        up_u, up_p = np.cumsum(h[:bins][::-1]) / n, np.cumsum(h[bins:][::-1]) / n_p
        large = up_p >= 0.9  # smaller sets would flatter what the first score has learnt by heart
        return float(np.clip((up_u[large] / up_p[large]).min(), 0.05, 0.99))

    w = np.zeros(d)
    if prior is None:
        w = newton(w, 0.5, 4)
        prior = estimate(w)
    w = newton(w, prior, steps)
    out = w * scale
    out[-1] += -(shift * w)[:-1].sum() + 0
    return out, prior


def quality_scores(
    docs: DataFrame, labels: DataFrame, learn: str, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
    label_col: str = "quality", prior: float | None = None, threshold: float = 0.3,
) -> DataFrame:
    """One row per input row: id, learnt (whether it could be learnt from), score, predicted.

    learn is an SQL condition on the column ``id``: the rows that may be learnt from. A trusted positive is a document whose
    labels are all 1. Null and empty texts are scored by their own feature; a null id is scored but never learnt from.
    Repeated rows weigh as often as they stand. Without positives all scores are 0.5. An empty table gives an empty
    result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "quality")

    def extract(batches):
        for b in slices(batches):
            x = np.stack([features(t.as_py()) for t in b.column(1)]) if b.num_rows else np.zeros((0, SIZE), np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * SIZE, pa.int32()), pa.array(x.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["id", "x"])

    table = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(extract, "id long, x array<float>")
    good = labels.groupBy(F.col(label_id).cast("long").alias("label_id")).agg((F.min(label_col) == 1).alias("positive")).where("positive")
    table = table.join(good, F.col("id") == F.col("label_id"), "left").select("id", "x", F.coalesce("positive", F.lit(False)).alias("positive"), F.coalesce(F.expr(learn), F.lit(False)).alias("learnt"))
    table = scratch.save(table)
    weights, _ = fit(table.where("learnt"), prior)

    def score(batches):
        for b in batches:
            x = np.asarray(b.column("x").flatten(), np.float32).reshape(b.num_rows, SIZE).astype(float)
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -50, 50)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("learnt"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["id", "learnt", "score", "predicted"])

    return table.select("id", "x", "learnt").mapInArrow(score, "id long, learnt boolean, score double, predicted int").withColumnRenamed("id", id_col)
