"""Connected components by alternating large-star and small-star steps over an edge table.

Each step is two keyed aggregations and two joins; no vertex's neighbours are ever gathered in one row,
so a hub with a third of all edges is only a skewed join side, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlight.plans.durable import Scratch


def splittable(col: str):
    """A join key of its own exchange: both sides are then dealt anew and a hot key can be split."""
    return F.concat(F.col(col).cast("string"), F.lit(""))


def _star(edges: DataFrame, keep_larger: bool) -> DataFrame:
    """edges(u, v) with u > v. Connects each vertex's (larger, or smaller) neighbours to its least one."""
    if keep_larger:
        pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
    joined = pairs.withColumn("_k", splittable("u")).join(
        least.select(F.concat(F.col("u").cast("string"), F.lit("")).alias("_k"), "m"), "_k"
    )
    if keep_larger:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component): each vertex of an edge with the least vertex that it reaches.

    Self loops, repeated and reversed edges do not matter; rows with a null end are ignored; an edge table
    without rows gives a table without rows. Vertices without an edge are not listed.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = scratch.save(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    state = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).alias("s")
    before = e.agg(state).first().s
    for _ in range(max_rounds):
        mid = _star(e, True)
        nxt = scratch.save(_star(mid, False))
        after = nxt.agg(state).first().s
        scratch.drop(e)
        e = nxt
        if after == before:
            roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
