"""Exact top-k search by MaxScore over sharded postings.

A vector is a document whose terms are its dimensions; a query's score is the sum of weight times value. A shard holds a
posting list for each term: its documents in order of value, cut into buckets of equal length with their bounds. Measured
from the term's lower bound, contributions are not negative. A query's threshold is the k-th best score of a few documents
that stand highest in its widest lists. The lists' upper buckets are essential, the rest of each list and the narrow terms
are not, if the bounds of all that is non-essential together don't exceed the threshold: a document that stands in no
essential bucket can't be among the k best. Only the essential postings are traversed; the documents met are probed term
by term, the widest first, and dropped as soon as their score so far and the bounds of the terms to come don't reach the
threshold. The shards' best k are merged.

Vectors whose values lie alike in all dimensions have no short lists: nearly every document then stands in some upper
bucket, and what is saved are the probes. Counts of documents and postings touched are reported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from arborlight.llm.common import arrow_out, grouped_arrow
from arborlight.plans.durable import Scratch


class Shard:
    """Posting lists of a shard's documents: by term, documents in ascending order of value, and the values at the buckets' edges."""

    def __init__(self, docs: np.ndarray, doc_ids: np.ndarray, buckets: int = 16):
        by_id = np.argsort(doc_ids, kind="stable")
        self.ids, self.columns = doc_ids[by_id], np.ascontiguousarray(docs[by_id].T)
        self.order = np.argsort(self.columns, axis=1, kind="stable").astype(np.int32)
        n = len(doc_ids)
        self.edges = np.array([n * i // buckets for i in range(buckets + 1)])
        ranked = np.take_along_axis(self.columns, self.order, axis=1)
        self.low, self.high = ranked[:, 0], ranked[:, -1]
        #: tops[i]: the greatest value below edge i of the lists, bottoms[i]: the least value from edge i on.
        self.tops = ranked[:, np.maximum(self.edges - 1, 0)].T
        self.bottoms = ranked[:, np.minimum(self.edges, n - 1)].T

    def search(self, w: np.ndarray, own: int, k: int, touched: list | None = None) -> list[tuple]:
        """(-score, id) of the k best documents but those of the query's own id, ascending; ties to smaller ids."""
        n, d = len(self.ids), len(w)
        up = w > 0
        floor, ceiling = np.where(up, w * self.low, w * self.high), np.where(up, w * self.high, w * self.low)
        width = ceiling - floor
        by_width = np.argsort(-width.astype(float), kind="stable")
        mine = self.ids == own
        seeds = np.unique(np.concatenate([self.order[t][-2 * k - 1 :] if up[t] else self.order[t][: 2 * k + 1] for t in by_width[:8]]))
        seeds = seeds[~mine[seeds]]
        scores = np.sort(w @ self.columns[:, seeds])[::-1] if len(seeds) else seeds
        need = scores[k - 1] if len(seeds) >= k else None
        # bounds[i, t]: what term t adds at most for documents below its essential buckets, if these are all but i of them
        bounds = np.where(up[None, :], w[None, :] * self.tops, (w[None, :] * self.bottoms)[::-1])
        met, postings = np.flatnonzero(~mine), n * d
        if need is not None:
            for narrow in (0, d // 2, d * 3 // 4, d * 7 // 8):  # the last so many terms have no essential bucket
                wide, rest = by_width[: d - narrow], ceiling[by_width[d - narrow :]].sum() if narrow else 0
                fits = np.flatnonzero((bounds[:, wide].sum(axis=1) + rest < need).astype(bool))
                if len(fits) and (size := (n - self.edges[fits[-1]]) * len(wide)) < postings:
                    postings, best_cut = size, (wide, n - int(self.edges[fits[-1]]))
            if postings < n:
                wide, m = best_cut
                met = np.unique(np.concatenate([self.order[t][n - m :] if up[t] else self.order[t][:m] for t in wide])) if m else met[:0]
                met = met[~mine[met]]
        if touched is not None:
            touched.append((len(met), min(postings, n * d)))
        score = np.zeros(len(met), w.dtype)
        left = np.concatenate([np.cumsum(ceiling[by_width][::-1])[::-1], [0]])
        for i in range(0, d, 8):
            if need is not None and i:
                alive = score + left[i] >= need
                if not alive.all():
                    met, score = met[alive], score[alive]
            terms = by_width[i : i + 8]
            score += w[terms] @ (self.columns[terms] if len(met) == n else self.columns[np.ix_(terms, met)])
        if len(met) > 4 * k:
            top = np.sort(score)[-k]
            met, score = met[score >= top], score[score >= top]
        return sorted(zip((-score).tolist(), self.ids[met].tolist(), strict=True))[:k]


def search_shard(queries: np.ndarray, query_ids: np.ndarray, docs: np.ndarray, doc_ids: np.ndarray, k: int, touched: list | None = None):
    """(query index, doc id, score) of each query's k best documents of the shard, itself left out; ties to smaller ids.

    Integer arithmetic: in double precision where all sums stay below 2^52, else in Python's integers. touched gets
    (documents met, postings traversed) of each query.
    """
    most = float(np.abs(docs).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, docs.shape[1])
    kind = np.float64 if most < 2.0**52 else object
    shard = Shard(docs.astype(kind), doc_ids)
    for q, (w, own) in enumerate(zip(queries.astype(kind), query_ids, strict=True)):
        for negative, doc in shard.search(w, own, k, touched):
            yield q, int(doc), int(-negative)


def exact_top_k(
    queries: DataFrame, docs: DataFrame, id_col: str = "id", vec_col: str = "terms", k: int = 5,
    shard_rows: int = 8192, query_block: int = 16384,
) -> DataFrame:
    """(query_id, rank from 1, id, score) of each query's k documents of the greatest integer inner product.

    vec_col is array<bigint>; rows whose vector or id is null or holds a null take no part. A document with the query's own id
    is left out. With fewer than k documents all are returned. Only vectors of one length are compared. Ties go to the
    smaller id; a document that repeats with its id is one result for each row. Empty inputs give an empty result.

    Every query meets every shard: each document is sent once for each ``query_block`` queries, each query once for each
    ``shard_rows`` documents. Both may grow with an executor's memory (a row takes 16 bytes a dimension in a task).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "topk")
    usable = f"`{id_col}` is not null and {vec_col} is not null and size({vec_col}) > 0 and not exists({vec_col}, x -> x is null)"

    def prepared(df):
        return df.where(usable).select(F.col(id_col).cast("long").alias("id"), F.size(vec_col).alias("dim"), F.col(vec_col).alias("vec"))

    d, q = scratch.save(prepared(docs)), scratch.save(prepared(queries))
    n = d.agg(F.count(F.lit(1)).alias("n")).first().n
    m = q.agg(F.count(F.lit(1)).alias("n")).first().n
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // query_block))
    d = d.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("is_query", F.lit(False))
    q = q.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("is_query", F.lit(True))
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def search(groups):
        for t in groups:
            width = t.column("dim")[0].as_py()
            vec = np.array(t.column("vec").combine_chunks().flatten().to_numpy(), np.int64).reshape(-1, width)
            ids, asks = t.column("id").to_numpy(), t.column("is_query").to_numpy(zero_copy_only=False)
            if asks.all() or not asks.any():
                continue
            found = list(search_shard(vec[asks], ids[asks], vec[~asks], ids[~asks], k))
            named = ids[asks]
            yield arrow_out(schema, {"query_id": [int(named[x[0]]) for x in found], "id": [x[1] for x in found], "score": [x[2] for x in found]})

    columns = ["dim", "block", "shard", "is_query", "id", "vec"]
    found = grouped_arrow(d.select(columns).unionByName(q.select(columns)), ["dim", "block", "shard"], search, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
