"""Join-shaped operators: imports, intervals, manifests, snapshots, searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlight.functions.scalar import normalize_package, package_names


def suffixes(path: Column, sep: str = "/") -> Column:
    """All suffixes of a path at its separators, itself included."""
    parts = F.split(path, f"[{sep}]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), sep))


def resolve_by_suffix(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports(id, module) with the least of files(path) that ends with the module's path at a separator; null where none does."""
    by_suffix = files.select("path", F.explode(suffixes(F.col("path"))).alias("suffix")).groupBy("suffix").agg(F.min("path").alias("resolved"))
    return imports.join(by_suffix, F.col("module") == F.col("suffix"), "left").drop("suffix")


def resolve_by_candidates(imports: DataFrame, files: DataFrame, endings: list[str]) -> DataFrame:
    """imports(id, base) with the first existing of base + ending, in the endings' order."""
    tried = imports.select("*", F.posexplode(F.array(*[F.concat("base", F.lit(e)) for e in endings])).alias("prio", "candidate"))
    found = tried.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate").groupBy("id").agg(F.min_by("candidate", "prio").alias("resolved"))
    return imports.join(found, "id", "left")


_LEAST_LEVEL = 6


def _level(lo: str, hi: str) -> Column:
    """The dyadic level of an interval: cells of 2^level are at least as long as it, so it touches two of them at most."""
    return F.greatest(F.lit(_LEAST_LEVEL), F.ceil(F.log2(F.greatest(F.col(hi) - F.col(lo) + 1, F.lit(1)).cast("double"))).cast("int"))


def _levels(df: DataFrame) -> list[int]:
    """The levels that occur: 64 at most."""
    return sorted(r[0] for r in df.select("_level").where("_level is not null").distinct().collect())


def _cells(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """A row for each cell of its level that an interval touches."""
    at = lambda c: F.expr(f"cast(floor({c} / power(2d, _level)) as bigint)")
    return df.withColumn("_cell", F.explode(F.array_distinct(F.array(at(lo), at(hi)))))


def _at_levels(df: DataFrame, levels: list[int], least: Column) -> DataFrame:
    """A row for each of the levels from ``least`` on."""
    return df.withColumn("_level", F.explode(F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x >= least)))


def innermost(points: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """points(key, point_id, at) with the innermost of intervals(key, span_id, lo, hi) that holds each: greatest lo, least hi, greatest id.

    An interval is longer than its cell, half its dyadic length, so it touches three cells at most and in each reaches to the end or
    from the start: of a cell's points it holds those from lo on, or those up to hi. The best is then a running maximum over
    sorted cells, and no point is ever paired with the intervals that hold it. Equal intervals are one, and so are equal places.
    """
    long = lambda c: F.col(c).cast("long").alias(c)
    spans = intervals.select(key, long("lo"), long("hi"), "span_id").where("lo <= hi").groupBy(key, "lo", "hi").agg(F.max("span_id").alias("span_id"))
    spans = spans.withColumn("_level", F.char_length(F.bin(F.col("hi") - F.col("lo"))))  # exact: 2^(_level - 1) < length <= 2^_level
    spans = spans.select("*", F.expr("shiftright(lo, _level - 1) as _first"), F.expr("shiftright(hi, _level - 1) as _last")).withColumn("_cell", F.explode(F.sequence("_first", "_last")))
    upto = (F.col("_cell") == F.col("_last")) & (F.col("_first") < F.col("_last"))
    spans = spans.select(key, "_level", "_cell", upto.alias("_upto"), F.when(upto, F.col("hi")).otherwise(F.col("lo")).alias("at"), F.struct("lo", (-F.col("hi")).alias("hi"), "span_id").alias("_best"))
    spans = spans.groupBy(key, "_level", "_cell", "_upto", "at").agg(F.max("_best").alias("_best"))
    levels = intervals.where("lo <= hi").groupBy(key).agg(F.collect_set(F.char_length(F.bin(F.col("hi").cast("long") - F.col("lo").cast("long")))).alias("_levels"))  # 64 at most
    asked = points.select(key, long("at")).where("at is not null").distinct().join(levels, key).withColumn("_level", F.explode("_levels"))
    asked = asked.select(key, "_level", F.expr("shiftright(at, _level - 1) as _cell"), F.lit(None).cast("boolean").alias("_upto"), "at", F.lit(None).cast(spans.schema["_best"].dataType).alias("_best"))
    cell = Window.partitionBy(key, "_level", "_cell")
    so_far = lambda order, kind: F.max(F.when(kind, F.col("_best"))).over(cell.orderBy(*order, F.col("_upto").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = spans.unionByName(asked).select(key, "at", "_upto", so_far([F.col("at")], ~F.col("_upto")).alias("_from"), so_far([F.desc("at")], F.col("_upto")).alias("_to"))
    best = met.where("_upto is null").groupBy(key, "at").agg(F.max(F.greatest("_from", "_to")).alias("_best")).where("_best is not null")
    return points.join(best.select(key, "at", F.col("_best.span_id").alias("span_id")), [key, "at"], "left").select(*points.columns, "span_id")


_GATHER = 4096


def _gathered(df: DataFrame, by: list[str], one: str) -> DataFrame:
    """A row for each value of ``by`` with all values of ``one`` as an array of structs; more than _GATHER equal rows are dealt to several."""
    large = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > _GATHER)  # at most a row in _GATHER
    part = F.when(F.col("_n").isNotNull(), F.expr(f"pmod(xxhash64({one}), ceil(_n * 2 / {_GATHER}))")).otherwise(F.lit(0))
    return df.join(large, by, "left").withColumn("_part", part).groupBy(*by, "_part").agg(F.collect_list(F.struct(one)).alias(f"{one}s")).drop("_part")


def overlapping(ranges: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, range_id, span_id) of ranges(lo, hi) and spans(start, end) that overlap, each pair once.

    A pair meets at the higher of its two dyadic levels, where each side touches two cells at most, in the first cell both touch.
    Equal intervals meet once for all their ids, which are written out last: nothing that is dealt out grows with the pairs. Cells
    are dealt to a fixed number of tasks, as their work says nothing of their bytes.
    """
    a = ranges.select(key, "range_id", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")).withColumn("_level", _level("lo", "hi"))
    b = spans.select(key, "span_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).withColumn("_level", _level("start", "end"))
    spark = ranges.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    a_levels, b_levels = _levels(a), _levels(b)
    a, b = _gathered(a, [key, "lo", "hi", "_level"], "range_id"), _gathered(b, [key, "start", "end", "_level"], "span_id")

    def pairs(high, levels, h_lo, h_hi, low, l_lo, l_hi, strict):
        own = F.col("_own") + (1 if strict else 0)
        lower = _at_levels(low.withColumnRenamed("_level", "_own"), levels, own)
        at = [key, "_level", "_cell"]
        met = _cells(high, h_lo, h_hi).repartition(tasks, *at).join(_cells(lower, l_lo, l_hi).repartition(tasks, *at), at).where("lo <= end and hi >= start")
        met = met.where(F.col("_cell") == F.expr("cast(floor(greatest(lo, start) / power(2d, _level)) as bigint)"))
        return met.select(key, "span_ids", F.inline("range_ids")).select(key, "range_id", F.inline("span_ids"))

    return pairs(a, a_levels, "lo", "hi", b, "start", "end", False).unionByName(pairs(b, b_levels, "start", "end", a, "lo", "hi", True))


def without_containers(seeds: DataFrame) -> DataFrame:
    """seeds(file, id, parent) without those that have a seeded child."""
    held = seeds.where("parent is not null").select("file", F.col("parent").alias("id")).distinct()
    return seeds.join(held, ["file", "id"], "left_anti")


def ancestors(path: Column) -> Column:
    """The folders above a file, the nearest first, down to ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def same_row(a: DataFrame, b: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """a joined with b on columns of the same names, where null equals null."""
    b = b.withColumnsRenamed({c: f"_of_{c}" for c in by})
    on = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    return a.join(b, on, how).drop(*[f"_of_{c}" for c in by])


def declared_imports(imports: DataFrame, deps: DataFrame) -> DataFrame:
    """imports(id, file, eco, package) with (declared, dev_only) by the manifests deps(eco, dir, name, section) in folders above.

    What is declared depends on file, ecosystem and package alone, so it is looked up once for each of these; ids need not be unique.
    A null file stands in the root folder.
    """
    asked = imports.select("file", "eco", "package").distinct()
    up = asked.select("*", F.explode(ancestors(F.coalesce("file", F.lit("")))).alias("dir")).withColumn("name", F.explode(package_names(F.col("eco"), F.col("package"))))
    d = deps.select("eco", "dir", normalize_package(F.col("name")).alias("name"), F.col("section").isin("dev", "test").alias("dev")).distinct()
    met = up.join(d, ["eco", "dir", "name"]).groupBy("file", "eco", "package").agg(F.bool_and("dev").alias("dev_only"))
    out = same_row(imports, met, ["file", "eco", "package"])
    return out.select(*imports.columns, F.col("dev_only").isNotNull().alias("declared"), F.coalesce("dev_only", F.lit(False)).alias("dev_only"))


def dependency_findings(imports: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, rule, confidence) of imports(id, eco, package, declared, dev_only, is_test, optional, has_manifest); registry(eco, package, exists): no row is unknown."""
    from arborlight.operators.dependencies import distribution, import_confidence

    x = imports.join(registry, ["eco", "package"], "left")
    absent = F.coalesce(~F.col("exists"), F.lit(False))
    rule = F.when(~F.col("declared") & absent, "nonexistent-package").when(~F.col("declared"), "undeclared-dependency").when(F.col("dev_only") & ~F.col("is_test"), "dev-dependency-in-source")
    mapped = distribution(F.col("eco"), F.col("package")).isNotNull()
    conf = F.when(rule == "dev-dependency-in-source", 0.50).otherwise(import_confidence(absent, F.col("eco"), mapped, F.col("has_manifest"), F.col("optional")))
    return x.withColumns({"rule": rule, "confidence": conf}).where("rule is not null").select("id", "rule", "confidence")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of snapshots (path, hash): added, removed, modified; what is equal is left out."""
    both = before.select("path", F.col("hash").alias("_b")).join(after.select("path", F.col("hash").alias("_a")), "path", "full_outer")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def missing_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct names (name) of before that after doesn't hold; null names are left out."""
    return before.where("name is not null").join(after.select("name"), "name", "left_anti").select("name").distinct()


def search(symbols: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """symbols(sym_id, name, file, line) that hold the text: equal, equal but for case, prefix, part; then file, line and id."""
    low, name = F.lower("name"), F.col("name")
    tier = F.when(name == text, 0).when(low == text.lower(), 1).when(low.startswith(text.lower()), 2).when(low.contains(text.lower()), 3)
    return symbols.withColumn("tier", tier).where("tier is not null").orderBy("tier", "file", "line", "sym_id").limit(max(1, min(200, limit)))


def incoming(edges: DataFrame, symbols: DataFrame, wanted: list[str], limit: int = 500) -> DataFrame:
    """Edges (src, dst, line, conf) into the symbols (id, name, file) of these names, whatever their case, with the caller's name."""
    goal = symbols.where(F.lower("name").isin([w.lower() for w in wanted])).select(F.col("id").alias("dst"), F.col("name").alias("target"))
    caller = symbols.select(F.col("id").alias("src"), F.col("name").alias("caller"), "file")
    met = edges.join(goal, "dst").join(caller, "src", "left").withColumn("caller", F.coalesce("caller", F.lit("<module level>")))
    return met.withColumn("confidence", F.round("conf", 2)).select("target", "caller", "file", "line", "confidence", "src").orderBy(F.desc("confidence"), "file", "line", "src", "target").limit(max(1, min(500, limit)))


def within_previous(lines: DataFrame, flag: str, n: int, out: str) -> DataFrame:
    """lines(path, hunk, pos, ...): whether the flag stands on one of the n lines before, in the same hunk."""
    w = Window.partitionBy("path").orderBy("pos").rowsBetween(-n, -1)
    return lines.withColumn(out, F.coalesce(F.max(F.when(F.col(flag), F.col("hunk"))).over(w) == F.col("hunk"), F.lit(False)))


def merged_imports(imports: DataFrame) -> DataFrame:
    """imports(stmt, module, name): one row for each statement and module, with its distinct names in order; null names add none."""
    return imports.groupBy("stmt", "module").agg(F.array_sort(F.collect_set("name")).alias("names"))
