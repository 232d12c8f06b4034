"""Findings: dead-code scores, the multiset baseline, verdicts, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlight.functions.scalar import level, rounded

BONUSES = (("private", 0.10), ("census_zero", 0.15))
#: In the order in which they are added up.
PENALTIES = (("dynamic", 0.20), ("in_string", 0.15), ("decorated", 0.30), ("subclass", 0.25), ("framework", 0.25), ("exported", 0.10), ("imported", 0.20), ("broken", 0.10))


def dead_score(flags: dict[str, Column], test_only: Column) -> Column:
    """Confidence that a symbol is dead: 0.70 and bonuses, times 1 less the penalties, within 0 and 0.99; test-only at most 0.85."""
    add = lambda parts: reduce(lambda a, p: a + F.when(flags.get(p[0], F.lit(False)), p[1]).otherwise(0.0), parts, F.lit(0.0))
    c = F.greatest(F.lit(0.0), F.least(F.lit(0.99), (F.lit(0.70) + add(BONUSES)) * (F.lit(1.0) - add(PENALTIES))))
    return rounded(F.when(test_only, F.least(c, F.lit(0.85))).otherwise(c))


def new_findings(current: DataFrame, baseline: DataFrame, parts: int = 64) -> DataFrame:
    """Findings (fp, seq, ...) beyond the baseline's (fp, count): of each fingerprint the first ``count`` by seq, which tells rows apart, are known.

    Only rows whose fingerprint is in the baseline are ranked, in parts first: of each part the first ``count`` can be known, so one
    fingerprint with a large share of all rows is ranked by many tasks, and what is left by one.
    """
    met = current.select("fp", "seq").join(baseline.select("fp", "count"), "fp").withColumn("_part", F.pmod(F.xxhash64("seq"), F.lit(parts)))
    first = met.withColumn("_n", F.row_number().over(Window.partitionBy("fp", "_part").orderBy("seq"))).where("_n <= count")
    known = first.withColumn("_n", F.row_number().over(Window.partitionBy("fp").orderBy("seq"))).where("_n <= count").select("fp", "seq")
    return current.join(known, ["fp", "seq"], "left_anti").select(current.columns)


def fixed_findings(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(fp, fixed): how many of the baseline's are no longer there."""
    now = current.groupBy("fp").agg(F.count(F.lit(1)).alias("now"))
    left = F.col("count") - F.coalesce("now", F.lit(0))
    return baseline.join(now, "fp", "left").where(left > 0).select("fp", left.cast("long").alias("fixed"))


def retained_baseline(current: DataFrame, baseline: DataFrame, observed: Column) -> DataFrame:
    """(fp, count) to write: counts of now, and what wasn't observed kept at the greater count."""
    now = current.groupBy("fp").agg(F.count(F.lit(1)).alias("now"))
    both = baseline.join(now, "fp", "full_outer")
    keep = F.when(observed, F.lit(0)).otherwise(F.coalesce("count", F.lit(0)))
    return both.select("fp", F.greatest(F.coalesce("now", F.lit(0)), keep).cast("long").alias("count")).where(F.col("count") > 0)


def verdict(new: DataFrame, thresholds: dict[str, str], step_failed: bool = False, fresh_blocked: bool = False, weakening: str = "weakening", update: bool = False) -> DataFrame:
    """One row: verdict, tripped, weakening_tripped. new(category, level_rank); thresholds: least level by category."""
    rank = {"low": 0, "medium": 1, "high": 2}
    hit = F.lit(False)
    for category, name in thresholds.items():
        hit = hit | ((F.col("category") == category) & (F.col("level_rank") >= rank[name]))
    one = new.agg(F.count_if(hit & (F.col("category") != weakening)).alias("tripped"), F.count_if(hit & (F.col("category") == weakening)).alias("weakening_tripped"))
    incomplete = F.lit(step_failed) | (F.lit(fresh_blocked) & (F.col("tripped") == 0) & (F.col("weakening_tripped") == 0))
    v = F.when(incomplete, "incomplete").when(F.col("weakening_tripped") > 0, "fail").when(F.lit(update), "baseline-updated").when(F.col("tripped") > 0, "fail").otherwise("pass")
    return one.withColumn("verdict", v)


def summary(findings: DataFrame) -> DataFrame:
    """Counts by level of confidence."""
    lev = level(F.col("confidence"))
    return findings.agg(*[F.count_if(lev == name).alias(name) for name in ("high", "medium", "low")])


def top(findings: DataFrame, n: int) -> DataFrame:
    """The n findings of greatest confidence; ties by their sequence."""
    return findings.orderBy(F.desc("confidence"), "seq").limit(n)


def merge_reports(*reports: DataFrame) -> DataFrame:
    """Reports as one, without repeats of (file, line, column, rule, message); the first (by seq) stays."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reports)
    keys = ["file", "line", "col", "rule", "message"]
    rest = [c for c in every.columns if c not in keys]
    return every.groupBy(*keys).agg(F.min_by(F.struct(*rest), "seq").alias("_r")).select(*keys, "_r.*")
