"""Hosts of engine messages that are told only from all parts of a project: partial classes merged, chains of bases walked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlight.plans.durable import Scratch


def path_root(path: Column) -> Column:
    """What stands before the first folder Assets; parts of a class are merged below one such root."""
    return F.regexp_extract(path, r"^((?:.*?/)?)Assets/", 1)


def _token(unity: Column, prefix: str) -> Column:
    return F.nullif(F.regexp_extract(unity, rf"(?:^| ){prefix}(\S+)", 1), F.lit(""))


def merged_hosts(graph: dict[str, DataFrame]) -> DataFrame:
    """(sym_id, live, unresolved_base): messages whose host is proven are live, and so are all parts of the host; those of a host with a
    base outside the project, below Assets, keep that base's name. What has neither is not listed.

    proven: a part names an engine base, or a base that is a class of the project which is proven. Interfaces don't count.
    Both spread backwards over the chains of bases by frontiers, so chains may be of any length and may go round.
    """
    scratch = Scratch(graph["symbols"].sparkSession, "hosts")
    files = graph["files"].select("file_id", "path")
    s = graph["symbols"].where("unity is not null").join(files, "file_id").withColumn("root", path_root(F.col("path")))
    parts = scratch.save(s.where("kind = 'class'").select("sym_id", "root", "qname", "name", _token(F.col("unity"), "base-unity:").alias("engine"), F.split(_token(F.col("unity"), "bases:"), ",").alias("bases")))
    one = parts.select("root", "qname", "name").distinct()
    bases = parts.select("root", "qname", F.explode("bases").alias("base")).where(~F.col("base").rlike("^I[A-Z]")).distinct()
    links = scratch.save(bases.join(one.select("root", F.col("name").alias("base"), F.col("qname").alias("of")), ["root", "base"], "left"))

    def spread(start: DataFrame) -> DataFrame:
        found = [scratch.save(start)]
        while not found[-1].isEmpty():
            known = reduce(DataFrame.unionByName, found).select("root", "qname")
            nxt = links.join(found[-1].select("root", F.col("qname").alias("of"), "why"), ["root", "of"]).groupBy("root", "qname").agg(F.min("why").alias("why"))
            found.append(scratch.save(nxt.join(known, ["root", "qname"], "left_anti")))
        return reduce(DataFrame.unionByName, found)

    proven = spread(parts.where("engine is not null").groupBy("root", "qname").agg(F.min("engine").alias("why")))
    unknown = spread(links.where("of is null").groupBy("root", "qname").agg(F.min("base").alias("why")))
    parents = graph["symbols"].select("file_id", F.col("idx").alias("parent_idx"), F.col("qname").alias("host"))
    asked = s.where("unity = 'msg'").join(parents, ["file_id", "parent_idx"]).select("sym_id", "root", "host", "path")
    live = asked.join(proven.select("root", F.col("qname").alias("host")), ["root", "host"], "left_semi")
    whole = parts.join(live.select("root", F.col("host").alias("qname")).distinct(), ["root", "qname"], "left_semi").select("sym_id")
    rest = asked.join(live.select("sym_id"), "sym_id", "left_anti").where("path rlike '(^|/)Assets/'").join(unknown.select("root", F.col("qname").alias("host"), F.col("why").alias("unresolved_base")), ["root", "host"])
    out = live.select("sym_id").unionByName(whole).distinct().select("sym_id", F.lit(True).alias("live"), F.lit(None).cast("string").alias("unresolved_base"))
    return scratch.save(out.unionByName(rest.select("sym_id", F.lit(False).alias("live"), "unresolved_base")))
