"""Near-duplicate embeddings: an exact cosine join by the pigeonhole principle over subspaces.

Unit vectors a, b have cosine >= c iff |a - b|^2 <= 2 - 2c. After a rotation the coordinates are cut into blocks; each
block gets a share of the squared distance in proportion to its dimensions. If all blocks of a pair exceeded their
share, so would the sum: each pair within the limit is within the share of at least one block. Each block is
range-joined for itself, and the union of the candidates is verified by the cosine in double precision.

Equal vectors form a class that is joined once. The vectors of one label are dealt out in chunks, and each pair of chunks is
one task of bounded size, in which all blocks are joined: a vector is sent once for each chunk of its label, and each pair
of different vectors is met in one task only. (Grids over a block's coordinates were measured and given up: at a cosine
of 0.93 a block's radius exceeds the spread of its coordinates, so that cells prune nothing, and every block sends all
vectors again.) A task returns counts of links and a spanning forest of them; pairs are not gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlight.llm.common import Union, arrow_out, grouped_arrow
from arborlight.plans.components import connected_components, splittable
from arborlight.plans.durable import Scratch

#: Above the rounding of single precision.
_EPS = 1e-5


def rotation(dim: int, seed: int) -> np.ndarray:
    """A seeded orthogonal matrix: spreads variance over all blocks alike."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int, width: int) -> list[tuple[int, int]]:
    n = max(1, dim // width)
    cuts = [dim * i // n for i in range(n + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def candidates(p: np.ndarray, q: np.ndarray, spans: list[tuple[int, int]], limit: float) -> np.ndarray:
    """Whether each row of p and row of q (rotated unit vectors, single precision) are within the share of at least one block."""
    near = np.zeros((len(p), len(q)), bool)
    for s, e in spans:
        a, b = p[:, s:e], q[:, s:e]
        d = a @ b.T
        d *= -2
        d += (a**2).sum(1)[:, None]
        d += (b**2).sum(1)[None, :]
        near |= d <= np.float32(limit * (e - s) / p.shape[1] + _EPS)
    return near


def _pairs(ux: np.ndarray, uy: np.ndarray, rx: np.ndarray, ry: np.ndarray, same: bool, spans: list, limit: float, cosine: float, step: int = 256):
    """Index pairs whose cosine reaches the threshold; of one and the same chunk each pair once."""
    for i in range(0, len(rx), step):
        j = i if same else 0
        a_all, b_all = np.nonzero(candidates(rx[i : i + step], ry[j:], spans, limit))
        a_all, b_all = a_all + i, b_all + j
        if same:
            a_all, b_all = a_all[b_all > a_all], b_all[b_all > a_all]
        for k in range(0, len(a_all), 50_000):
            a, b = a_all[k : k + 50_000], b_all[k : k + 50_000]
            cos = (ux[a] * uy[b]).sum(1) / np.sqrt((ux[a] ** 2).sum(1) * (uy[b] ** 2).sum(1))
            yield a[cos >= cosine], b[cos >= cosine]


def _unit(x: np.ndarray) -> np.ndarray:
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    return unit / np.sqrt((unit**2).sum(1, keepdims=True))


def embedding_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label",
    cosine: float = 0.93, width: int = 8, chunk: int = 8192, seed: int = 11,
) -> DataFrame:
    """One row per input row: id, n_links (other rows within the cosine, same label), component_id, kept.

    Null labels, and vectors that are null, empty, zero or hold a null or non-finite component, link with nothing.
    Vectors of different lengths are not compared. Rows that repeat an id count as vectors of their own. A null id is
    linked and counted but names no component where another id is there. Empty tables give empty results; other
    columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embdup")
    limit = 2 - 2 * cosine + 1e-9
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vec_col).alias("vec"))
    bad = F.expr("vec is null or label is null or size(vec) = 0 or exists(vec, x -> x is null or isnan(x) or abs(x) = double('Infinity')) or forall(vec, x -> x = 0)")
    rows = rows.withColumn("cls", F.when(~bad, F.sha2(F.concat_ws(":", F.length("label"), "label", F.col("vec").cast("string")), 256)))
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.any_value("label").alias("label"), F.any_value("vec").alias("vec"))
    classes = scratch.save(classes)
    keyed = classes.withColumn("key", F.concat_ws("/", F.length("label"), "label", F.size("vec")))
    sizes = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("p")).where("p > 1")
    cut = keyed.join(sizes.select(F.concat("key", F.lit("")).alias("_k"), "p"), splittable("key") == F.col("_k"), "left").withColumn("p", F.coalesce("p", F.lit(1)))
    cut = cut.withColumn("c", F.pmod(F.xxhash64("cls"), F.col("p")).cast("int"))
    cut = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("p") - 1))).select("key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "cls", "n", "vec")
    link_schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("w", pa.int64())])

    def join(groups):
        for t in groups:
            if t.num_rows < 2:
                continue
            x = t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
            cls, n, c = t.column("cls").to_pylist(), t.column("n").to_numpy(), t.column("c").to_numpy()
            unit = _unit(x)
            rot, spans = (unit @ rotation(x.shape[1], seed)).astype(np.float32), blocks(x.shape[1], width)
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            p, q = np.flatnonzero(c == i), np.flatnonzero(c == j)
            uf, weight, edges = Union(t.num_rows), np.zeros(t.num_rows, np.int64), []
            for a, b in _pairs(unit[p], unit[q], rot[p], rot[q], i == j, spans, limit, cosine):
                a, b = p[a], q[b]
                np.add.at(weight, a, n[b])
                np.add.at(weight, b, n[a])
                edges += [(u, v) for u, v in zip(a.tolist(), b.tolist(), strict=True) if uf.join(u, v)]
            seen = np.flatnonzero(weight)
            if len(seen):
                yield arrow_out(link_schema, {
                    "a": [cls[k] for k in seen] + [cls[u] for u, _ in edges], "b": [None] * len(seen) + [cls[v] for _, v in edges],
                    "w": [*weight[seen].tolist(), *[None] * len(edges)]})

    links = scratch.save(grouped_arrow(cut, ["key", "i", "j"], join, "a string, b string, w long"))
    degree = links.where("b is null").groupBy("a").agg(F.sum("w").alias("w"))
    comps = connected_components(links.where("b is not null"), scratch)
    known = classes.select("cls", "rep", "n").join(degree, F.col("cls") == F.col("a"), "left").join(comps, F.col("cls") == F.col("id"), "left")
    known = known.select("cls", "rep", (F.col("n") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("comp"))
    least = known.groupBy("comp").agg(F.min("rep").alias("component_id"))
    known = known.join(least.select(F.concat("comp", F.lit("")).alias("_c"), "component_id"), splittable("comp") == F.col("_c"))
    out = rows.select("id", "cls").join(known.select(F.concat("cls", F.lit("")).alias("_k"), "n_links", "component_id"), splittable("cls") == F.col("_k"), "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.expr(f"`{id_col}` <=> component_id"))
