"""Repository maps and the impact of changes, over the tables of a code graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlight.functions.scalar import est_tokens, level, signature
from arborlight.operators.graph import pack_budget, pagerank
from arborlight.operators.relations import overlapping, without_containers
from arborlight.plans.durable import Scratch

# Kinds that a map shows, what an edge from a test weighs, and the least weight of an edge.
MAP_KINDS = ("function", "method", "class", "struct", "enum", "trait", "interface", "type", "const")
TEST_WEIGHT, LEAST_WEIGHT = 0.3, 0.05
MOST_DEPTH = 10


def ranks(graph: dict[str, DataFrame], focus: list[str] | None = None, rounds: int = 50) -> DataFrame:
    """(sym_id, rank, in_degree) of all symbols by weighted PageRank; module-level references come from their file's own node.

    focus: paths; half of the teleport goes to their symbols. Parallel edges each count; self loops don't.
    """
    files = graph["files"].select("file_id", "path", "is_test")
    sym = graph["symbols"].select("sym_id", "file_id")
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    nodes = sym.select(node("s", "sym_id").alias("id")).unionByName(files.select(node("f", "file_id").alias("id")))
    e = graph["edges"].join(sym.select(F.col("sym_id").alias("src_sym"), F.col("file_id").alias("_of")), "src_sym", "left").withColumn("file_id", F.coalesce("_of", "src_file"))
    e = e.join(files.select("file_id", "is_test"), "file_id", "left")
    weight = F.greatest(F.col("confidence"), F.lit(LEAST_WEIGHT)) * F.when(F.col("is_test"), TEST_WEIGHT).otherwise(1.0)
    e = e.select(F.coalesce(node("s", "src_sym"), node("f", "src_file")).alias("src"), node("s", "dst_sym").alias("dst"), weight.alias("weight")).where("src <> dst")
    e = Scratch(nodes.sparkSession, "map").save(e)
    near = None
    if focus:
        near = sym.join(files.where(F.col("path").isin(focus)), "file_id", "left_semi").select(node("s", "sym_id").alias("id"))
    rank = pagerank(nodes, e, rounds, focus=near)
    degree = e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    out = rank.where("id like 's%'").join(degree, "id", "left")
    return out.select(F.expr("cast(substring(id, 2) as bigint)").alias("sym_id"), "rank", F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def file_ranks(shown: DataFrame) -> DataFrame:
    """(path, rank): of shown(path, rank) the sum by file, greatest first, then by path."""
    return shown.groupBy("path").agg(F.sum("rank").alias("rank")).orderBy(F.desc("rank"), "path")


def repo_map(graph: dict[str, DataFrame], texts: DataFrame, budget: int = 1000, focus: list[str] | None = None, tests: bool = False, header: str = "# map: 999 files") -> DataFrame:
    """(path, file_rank, line, qname, kind, text, rank): the symbols that a budget of tokens has room for, the highest ranked first.

    texts(path, text) give signatures. A symbol costs its line, and its file's heading if that isn't shown yet; what doesn't fit is
    skipped and smaller ones are still tried.
    """
    files = graph["files"].select("file_id", "path", "is_generated", F.col("is_test").alias("file_test"))
    s = graph["symbols"].where(F.col("kind").isin(*MAP_KINDS) & (F.col("name") != "")).join(files.where("not is_generated"), "file_id")
    s = s if tests else s.where("not is_test and not file_test")
    s = s.join(ranks(graph, focus), "sym_id").join(texts.select("path", F.split("text", "\n").alias("lines")), "path", "left")
    head = signature(F.slice("lines", F.col("start_line").cast("int"), 4))
    s = s.select("sym_id", "path", F.col("start_line").alias("line"), "qname", "kind", "rank", F.coalesce(F.nullif(head, F.lit("")), F.col("qname")).alias("text"))
    s = Scratch(s.sparkSession, "map").save(s.withColumn("cost", est_tokens(F.concat(F.lit("  "), F.col("line").cast("string"), F.lit(": "), F.col("text")))).withColumn("head", est_tokens(F.concat("path", F.lit(":")))))
    taken = pack_budget(s.withColumnRenamed("sym_id", "id"), [F.desc("rank"), "qname", "id"], budget - -(-len(header) // 4), shared="path", shared_cost="head")
    shown = s.join(taken.select(F.col("id").alias("sym_id")), "sym_id", "left_semi")
    total = Window.partitionBy("path")
    return shown.select("path", F.sum("rank").over(total).alias("file_rank"), "line", "qname", "kind", "text", "rank").orderBy(F.desc("file_rank"), "path", "line")


def symbol_seeds(graph: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """(id): symbols whose name or qualified name is one of these, whatever its case; impl blocks are none."""
    low = [n.lower() for n in names]
    return graph["symbols"].where(F.lower("name").isin(low) | F.lower("qname").isin(low)).where("kind <> 'impl'").select(F.col("sym_id").alias("id"))


def range_seeds(graph: dict[str, DataFrame], ranges: DataFrame) -> DataFrame:
    """(id): symbols that changed lines (path, lo, hi) touch; of a container and its member, the member."""
    at = ranges.join(graph["files"].select("path", "file_id"), "path").select("file_id", F.monotonically_increasing_id().alias("range_id"), "lo", "hi")
    spans = graph["symbols"].where("kind <> 'impl'").select("file_id", F.col("sym_id").alias("span_id"), F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    hit = overlapping(at, spans, "file_id").select(F.col("span_id").alias("sym_id")).distinct()
    own = graph["symbols"].join(hit, "sym_id", "left_semi").select(F.col("file_id").alias("file"), F.col("idx").alias("id"), F.col("parent_idx").alias("parent"), "sym_id")
    return without_containers(own).select(F.col("sym_id").alias("id"))


def impact(graph: dict[str, DataFrame], seeds: DataFrame, depth: int = 4, least: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(callers, module level files, affected files).

    callers(sym_id, qname, file, line, distance, confidence, via, source, is_test): by distance, then confidence, file and line; each
    symbol at its least distance by its best path, with the caller's next symbol and the evidence of that edge. Seeds are left
    out. Module level files hold references outside any symbol to what was reached. affected(file, is_test): both, and which are tests.
    """
    depth = max(1, min(MOST_DEPTH, depth))
    scratch = Scratch(seeds.sparkSession, "impact")
    sym = graph["symbols"].select("sym_id", "file_id", "qname", F.col("start_line").alias("line"), F.col("is_test").alias("sym_test"))
    files = graph["files"].select("file_id", F.col("path").alias("file"), F.col("is_test").alias("file_test"))
    back = scratch.save(graph["edges"].where(F.col("confidence") >= least).select(F.col("dst_sym").alias("id"), F.col("src_sym").alias("caller"), "src_file", F.col("confidence").alias("edge"), "source"))
    level_ = scratch.save(seeds.select("id").distinct().select("id", F.lit(0).alias("distance"), F.lit(1.0).alias("confidence"), F.lit(None).cast("long").alias("via"), F.lit(None).cast("string").alias("source")))
    parts = [level_]
    for d in range(1, depth + 1):
        seen = reduce(DataFrame.unionByName, [p.select("id") for p in parts])
        met = parts[-1].select("id", F.col("confidence").alias("c")).join(back.where("caller is not null"), "id").withColumn("nc", F.col("c") * F.col("edge")).where(F.col("nc") >= least)
        best = met.groupBy(F.col("caller").alias("_c")).agg(F.max("nc").alias("confidence"), F.max_by(F.struct("id", "source"), F.struct("nc", -F.col("id"))).alias("b"))
        nxt = scratch.save(best.join(seen, F.col("_c") == F.col("id"), "left_anti").select(F.col("_c").alias("id"), F.lit(d).alias("distance"), "confidence", F.col("b.id").alias("via"), F.col("b.source").alias("source")))
        if nxt.isEmpty():
            break
        parts.append(nxt)
    reached = reduce(DataFrame.unionByName, parts)
    named = sym.select(F.col("sym_id").alias("via"), F.col("qname").alias("via_name"))
    callers = reached.where("distance > 0").withColumnRenamed("id", "sym_id").join(sym, "sym_id").join(files, "file_id").join(named, "via", "left")
    callers = callers.select("sym_id", "qname", "file", "line", "distance", F.round("confidence", 2).alias("confidence"), level(F.col("confidence")).alias("level"), F.col("via_name").alias("via"), "source", (F.col("sym_test") | F.col("file_test")).alias("is_test"))
    callers = scratch.save(callers)
    module = reached.where(F.col("distance") < depth).join(back.where("caller is null"), "id").select(F.col("src_file").alias("file_id")).distinct().join(files, "file_id").select("file", F.col("file_test").alias("is_test"))
    module = scratch.save(module)
    affected = callers.select("file", "is_test").unionByName(module).groupBy("file").agg(F.max("is_test").alias("is_test")).orderBy("file")
    return callers.orderBy("distance", F.desc("confidence"), "file", "line"), module.orderBy("file"), affected
