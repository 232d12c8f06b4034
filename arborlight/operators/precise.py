"""Precise edges of a code index laid over those told from names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlight.functions.paths import symbol_name
from arborlight.operators.relations import innermost
from arborlight.plans.durable import Scratch

PRECISE = 0.97


def _innermost(points: DataFrame, spans: DataFrame, id_: str) -> DataFrame:
    """points(point_id, file_id, line, ...) with id_, the innermost of spans(file_id, span_id, lo, hi) at its line."""
    p = points.select("file_id", "point_id", F.col("line").alias("at"))
    met = innermost(p, spans, "file_id").select("point_id", F.col("span_id").alias(id_))
    return points.join(met, "point_id", "left")


def apply_index(graph: dict[str, DataFrame], occurrences: DataFrame, mtimes: DataFrame | None = None) -> dict[str, DataFrame]:
    """edges, precise (sym_id), precise_refs (file_id, line, name) and coverage (one row) of a graph under an index.

    occurrences(path, symbol, line, is_def, is_import, mtime). Documents that match no file count as unmatched; those older than
    their file, by mtimes(path, mtime), as stale, and neither is used. A definition is the innermost symbol of its name at its line. A
    reference belongs to the definition in its own document, else to the only one, else to none. It is resolved if it has one, or
    if its symbol is defined in no index at all: then edges told from the name at that place go, and precise ones come.
    """
    scratch = Scratch(graph["files"].sparkSession, "scip")
    sym, files = graph["symbols"], graph["files"].select("file_id", "path")
    o = occurrences if "mtime" in occurrences.columns else occurrences.withColumn("mtime", F.lit(None).cast("long"))
    docs = o.groupBy("path").agg(F.max("mtime").alias("mtime")).join(files, "path", "left")
    docs = docs.join(mtimes.select("path", F.col("mtime").alias("file_mtime")), "path", "left") if mtimes is not None else docs.withColumn("file_mtime", F.lit(None).cast("long"))
    docs = scratch.save(docs.withColumns({"stale": F.col("file_id").isNotNull() & F.coalesce(F.col("file_mtime") > F.col("mtime"), F.lit(False))}))
    usable = docs.where("file_id is not null and not stale").select("path", "file_id")
    used = o.join(usable, "path").withColumn("name", symbol_name(F.col("symbol"))).where("name is not null")
    used = scratch.save(used.withColumn("point_id", F.xxhash64("file_id", "symbol", "line", "is_def", "is_import")).dropDuplicates(["point_id"]))
    spans = sym.select("file_id", F.col("sym_id").alias("span_id"), F.col("start_line").alias("lo"), F.col("end_line").alias("hi"), "name", "kind")
    # definitions: spans and points are keyed by the name as well
    key = F.concat_ws("\0", F.col("file_id").cast("string"), "name")
    defs = innermost(used.where("is_def").select(key.alias("k"), "point_id", F.col("line").alias("at")), spans.where("kind <> 'impl'").select(key.alias("k"), "span_id", "lo", "hi"), "k").where("span_id is not null")
    defs = scratch.save(used.join(defs.select("point_id", F.col("span_id").alias("sym_id")), "point_id").select("symbol", F.col("file_id").alias("def_file"), "sym_id").distinct())
    only = defs.groupBy("symbol").agg(F.countDistinct("sym_id").alias("n"), F.min("sym_id").alias("only"))
    own = defs.groupBy("symbol", F.col("def_file").alias("file_id")).agg(F.min("sym_id").alias("own"))
    known = o.where("is_def").select("symbol").distinct().withColumn("defined", F.lit(True))
    refs = used.where("not is_def").join(own, ["symbol", "file_id"], "left").join(only, "symbol", "left").join(known, "symbol", "left")
    refs = refs.withColumn("dst", F.coalesce("own", F.when(F.col("n") == 1, F.col("only")))).withColumn("resolved", F.col("dst").isNotNull() | F.col("defined").isNull())
    refs = scratch.save(refs.select("point_id", "file_id", "line", "name", "is_import", "dst", "resolved"))
    resolved = scratch.save(refs.where("resolved").select("file_id", "line", "name").distinct())
    edges = graph["edges"].join(sym.select(F.col("sym_id").alias("src_sym"), F.col("file_id").alias("_of")), "src_sym", "left").join(sym.select(F.col("sym_id").alias("dst_sym"), F.col("name").alias("_name")), "dst_sym", "left")
    edges = edges.withColumn("_file", F.coalesce("_of", "src_file"))
    kept = edges.join(resolved.select(F.col("file_id").alias("_file"), "line", F.col("name").alias("_name")), ["_file", "line", "_name"], "left_anti").select(graph["edges"].columns)
    kept = scratch.save(kept)
    uses = _innermost(refs.where("dst is not null and not is_import"), spans.select("file_id", "span_id", "lo", "hi"), "src_sym")
    first = Window.partitionBy("src_sym", F.when(F.col("src_sym").isNull(), F.col("file_id")), "dst", "line").orderBy("point_id")
    uses = uses.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    heads = sym.select(F.col("sym_id").alias("dst"), F.col("start_line").alias("_head"))
    uses = uses.join(heads, "dst").where("not (src_sym <=> dst and line = _head)")  # a symbol's own head is no use of it
    added = uses.select("src_sym", F.when(F.col("src_sym").isNull(), F.col("file_id")).alias("src_file"), F.col("dst").alias("dst_sym"), F.lit(True).alias("resolved"), F.lit("references").alias("kind"), "line", F.lit(PRECISE).alias("confidence"), F.lit("scip").alias("source"))
    added = scratch.save(added.select(graph["edges"].columns))
    precise = defs.select("sym_id").distinct()
    coverage = docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.expr("file_id is not null and not stale")).alias("matched"), F.count_if(F.expr("file_id is null")).alias("unmatched"), F.count_if("stale").alias("stale"))
    before, after, more, mapped = graph["edges"].count(), kept.count(), added.count(), precise.count()
    coverage = coverage.select("*", F.lit(before - after).alias("edges_replaced"), F.lit(more).alias("edges_added"), F.lit(mapped).alias("symbols_mapped"))
    return {"edges": kept.unionByName(added), "precise": precise, "precise_refs": resolved, "coverage": coverage}
