"""Dead code over the tables of a code graph: roots, closures, the census of names, scores, allow-lists."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlight.functions.scalar import glob_regex, level, sanitize
from arborlight.operators.edges import AMBIGUOUS
from arborlight.operators.findings import dead_score
from arborlight.operators.graph import closure_steps, reach

# Kinds that are reported, and kinds that a condition on a type accepts.
KINDS = ("function", "method", "class", "struct", "enum", "trait", "interface", "type", "const")
TYPE_KINDS = ("struct", "enum", "class", "trait", "type", "interface")


@dataclass(frozen=True)
class AllowList:
    """Suppressions: symbols by globs of name and path; dependencies by a glob of path, of package too where given."""

    symbols: list[dict] = field(default_factory=list)
    deps: list[dict] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> AllowList:
        d = tomllib.loads(text)
        for i, e in enumerate(d.get("allow", []), 1):
            if not e.get("symbol") and not e.get("path"):
                raise ValueError(f"allow entry {i} needs a symbol or a path")
        for i, e in enumerate(d.get("deps_allow", []), 1):
            if not e.get("path") or not str(e.get("reason", "")).strip():
                raise ValueError(f"deps_allow entry {i} needs a path and a reason")
        return cls(d.get("allow", []), d.get("deps_allow", []))

    def reason(self, name: Column, qname: Column, path: Column) -> Column:
        """The first matching entry's reason; null where none matches."""
        tests = []
        for e in self.symbols:
            ok = F.lit(True)
            if e.get("symbol"):
                ok = name.rlike(glob_regex(e["symbol"])) | qname.rlike(glob_regex(e["symbol"]))
            if e.get("path"):
                ok = ok & path.rlike(glob_regex(e["path"]))
            tests.append(F.when(ok, e.get("reason", "allow-listed")))
        return F.coalesce(*tests) if tests else F.lit(None).cast("string")

    def allows_dependency(self, path: Column, package: Column) -> Column:
        out = F.lit(False)
        for e in self.deps:
            ok = path.rlike(glob_regex(e["path"]))
            out = out | (ok & F.coalesce(package.rlike(glob_regex(e["package"])), F.lit(False)) if e.get("package") else ok)
        return F.coalesce(out, F.lit(False))


def name_counts(symbols: DataFrame) -> DataFrame:
    """(name, definitions): names over the cap are judged live and get no global edges."""
    return symbols.groupBy("name").agg(F.count(F.lit(1)).alias("definitions"))


def inbound(edges: DataFrame) -> DataFrame:
    """(sym_id, inbound, in_degree) of edges(src_sym, dst_sym): references from elsewhere, module level included; all edges but self loops by distinct source."""
    other = ~F.col("src_sym").eqNullSafe(F.col("dst_sym"))
    return edges.groupBy(F.col("dst_sym").alias("sym_id")).agg(F.count_if(other).alias("inbound"), F.countDistinct(F.when(other, F.col("src_sym"))).alias("callers"))


def census(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """symbols(sym_id, file_id, name, start_line, end_line) with other_refs: references of the name outside the symbol's own lines.

    Total of the name, less those inside: only references of the same file are joined with spans.
    """
    total = refs.groupBy("name").agg(F.count(F.lit(1)).alias("_total"))
    own = symbols.select("sym_id", "file_id", "name", "start_line", "end_line").join(refs.select("file_id", "name", "line"), ["file_id", "name"])
    own = own.where("line between start_line and end_line").groupBy("sym_id").agg(F.count(F.lit(1)).alias("_own"))
    out = symbols.join(total, "name", "left").join(own, "sym_id", "left")
    return out.withColumn("other_refs", F.coalesce("_total", F.lit(0)) - F.coalesce("_own", F.lit(0))).drop("_total", "_own")


def conditions(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of symbols with a conditional entry: (id) whose condition always holds, and (id, needs) that wait for another.

    'parent': the parent, if there is one. 'type:T': any type of that name; where the name isn't known, or is no type's, it holds.
    """
    c = symbols.where("entry is not null and entry_cond is not null")
    parent = c.where("entry_cond = 'parent'")
    typed = c.where("entry_cond like 'type:%'").select("sym_id", F.expr("substring(entry_cond, 6)").alias("t"))
    types = symbols.where(F.col("kind").isin(*TYPE_KINDS)).select(F.col("name").alias("t"), F.col("sym_id").alias("needs"))
    waits = parent.where("parent_id is not null").select(F.col("sym_id").alias("id"), F.col("parent_id").alias("needs")).unionByName(typed.join(types, "t").select(F.col("sym_id").alias("id"), "needs"))
    other = c.where("entry_cond <> 'parent' and entry_cond not like 'type:%'")
    free = parent.where("parent_id is null").select("sym_id").unionByName(typed.join(types.select("t").distinct(), "t", "left_anti").select("sym_id")).unionByName(other.select("sym_id"))
    return free.select(F.col("sym_id").alias("id")), waits


def dead_code(
    graph: dict[str, DataFrame], allow: AllowList | None = None, library: bool = False, kinds: tuple[str, ...] = KINDS, prefix: str = "", least: float = 0.70,
    test_only: bool = True, precise: DataFrame | None = None, precise_refs: DataFrame | None = None, merged: DataFrame | None = None,
) -> DataFrame:
    """Findings of symbols that nothing live reaches, or only tests do, ordered by confidence, file and line.

    graph: files, symbols, refs, imports, strings, edges. precise(sym_id): symbols that an index resolved by identity;
    precise_refs(file_id, line, name): occurrences that it resolved. merged(sym_id, live, unresolved_base): engine methods
    that are called by name: live ones are roots, those of an undecided host never score high.
    """
    allow = allow or AllowList()
    files = graph["files"].select("file_id", "path", F.col("is_test").alias("file_test"), "is_generated", "dynamic", "parse_status", F.col("lang").alias("file_lang"))
    parents = graph["symbols"].select("file_id", F.col("idx").alias("parent_idx"), F.col("sym_id").alias("parent_id"))
    s = graph["symbols"].join(parents, ["file_id", "parent_idx"], "left").join(files, "file_id")
    s = s.withColumns({"test": F.col("is_test") | F.col("file_test"), "reason": allow.reason(F.col("name"), F.col("qname"), F.col("path"))})
    html = graph["strings"].join(files.where("file_lang = 'html'"), "file_id").select("name").distinct().withColumn("in_html", F.lit(True))
    s = s.join(name_counts(graph["symbols"]), "name").join(html, "name", "left")
    s = s.join(merged.select("sym_id", "live", "unresolved_base"), "sym_id", "left") if merged is not None else s.withColumns({"live": F.lit(False), "unresolved_base": F.lit(None).cast("string")})
    s = s.withColumn("live", F.coalesce("live", F.lit(False)))
    top, entry, hot = F.col("parent_idx").isNull(), F.col("entry").isNotNull(), F.col("definitions") > AMBIGUOUS
    root = (
        F.when(F.col("test"), "test").when(F.col("keep").isNotNull() | F.col("reason").isNotNull() | ((F.col("kind") == "variable") & top) | (top & F.col("in_html")) | F.col("live"), "root")
        .when(entry, F.when(F.col("entry_cond").isNull(), "root").otherwise("condition")).when((F.lit(library) & F.col("exported")) | hot, "root")
    )
    s = s.withColumn("root", root)
    free, waits = conditions(s)
    waiting = s.where("root = 'condition'").select(F.col("sym_id").alias("id"))
    free, waits = free.join(waiting, "id", "left_semi"), waits.join(waiting, "id", "left_semi")
    edges = graph["edges"]
    module = edges.where("src_sym is null").join(files.select(F.col("file_id").alias("src_file"), "file_test"), "src_file", "left").select(F.col("dst_sym").alias("id"), F.coalesce("file_test", F.lit(False)).alias("of_test"))
    steps = closure_steps(edges.where("src_sym is not null").select(F.col("src_sym").alias("src"), F.col("dst_sym").alias("dst")), s.select(F.col("sym_id").alias("id"), F.col("parent_id").alias("parent")), waits)
    prod = reach(None, s.where("root = 'root'").select(F.col("sym_id").alias("id")).unionByName(free).unionByName(module.where("not of_test").select("id")), steps=steps)
    every = reach(None, s.where("root = 'test'").select(F.col("sym_id").alias("id")).unionByName(module.where("of_test").select("id")), steps=steps, known=prod)
    s = s.join(prod.select(F.col("id").alias("sym_id"), F.lit(True).alias("_prod")), "sym_id", "left").join(every.select(F.col("id").alias("sym_id"), F.lit(True).alias("_any")), "sym_id", "left")
    s = s.where("not test and not is_generated and keep is null and reason is null and entry is null and not live").where(F.col("definitions") <= AMBIGUOUS)
    s = s.where(F.col("kind").isin(*kinds) & F.col("path").startswith(prefix)).where("_prod is null").withColumn("dead", F.col("_any").isNull())
    s = s if test_only else s.where("dead")
    refs = graph["refs"] if precise_refs is None else graph["refs"].join(precise_refs.select("file_id", "line", "name").distinct(), ["file_id", "line", "name"], "left_anti")
    s = census(s, refs).join(inbound(edges), "sym_id", "left")
    s = s.join(graph["strings"].select("name").distinct().withColumn("in_string", F.lit(True)), "name", "left")
    outside = graph["imports"].join(files.where("not file_test").select("file_id"), "file_id", "left_semi").select(F.explode("names").alias("name")).distinct()
    s = s.join(outside.withColumn("imported", F.lit(True)), "name", "left")
    s = s.join(precise.select("sym_id").distinct().withColumn("precise", F.lit(True)), "sym_id", "left") if precise is not None else s.withColumn("precise", F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    s = s.withColumns({c: yes(F.col(c)) for c in ("in_string", "imported", "precise")})
    zero = F.when(F.col("precise"), ~F.col("in_string")).otherwise((F.col("other_refs") == 0) & ~F.col("in_string") & ~F.col("imported"))
    flags = {
        "private": ~F.col("exported"), "census_zero": zero, "dynamic": F.size("dynamic") > 0, "in_string": F.col("in_string"), "decorated": F.col("decorated"), "subclass": F.col("subclass"),
        "framework": F.col("framework_risk").isNotNull(), "exported": F.col("exported"), "imported": F.col("imported") & ~F.col("in_string") & ~F.col("precise"), "broken": F.col("parse_status") == "syntax-errors",
    }
    s = s.withColumn("confidence", dead_score(flags, ~F.col("dead") | F.col("unresolved_base").isNotNull())).where(F.col("confidence") >= least)
    lev = level(F.col("confidence"))
    inb = F.coalesce("inbound", F.lit(0))
    reached = F.when(~F.col("dead"), "reachable only from tests").when(inb == 0, "no reference edges from any code").otherwise(F.concat(inb.cast("string"), F.lit(" reference(s), all from code that is itself unreachable")))
    texts = lambda pairs: F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in pairs]), lambda x: x.isNotNull())
    s = s.withColumns({
        "evidence": F.concat(F.array(reached), texts([(flags["private"], "private to its module"), (flags["census_zero"], "the name occurs nowhere else")])),
        "fp_risks": texts([(flags["dynamic"], "dynamic access in this file"), (flags["in_string"], "the name is in a string"), (flags["decorated"], "decorated: a framework may invoke it"), (flags["subclass"], "may override a method of its base"), (flags["framework"], "a framework may call it"), (flags["exported"], "may be used from outside"), (flags["imported"], "named in an import or export list"), (flags["broken"], "the file has syntax errors"), (F.col("unresolved_base").isNotNull(), "its host type is not in the indexed code")]),
    })
    what = F.when(F.col("dead"), "` appears unused").otherwise("` is only used by tests")
    return s.select(
        F.lit("dead").alias("category"), F.when(F.col("dead"), "dead-code").otherwise("used-only-by-tests").alias("rule"), F.col("path").alias("file"), F.col("start_line").alias("line"),
        sanitize(F.col("qname")).alias("symbol"), F.lit(None).cast("long").alias("col"), "kind", F.when(lev == "low", "info").otherwise("warning").alias("severity"), "confidence", lev.alias("level"),
        F.when(F.col("precise"), "scip").otherwise("t0-treesitter").alias("source"), F.concat("kind", F.lit(" `"), sanitize(F.col("qname")), what).alias("message"), "evidence", "fp_risks",
        F.row_number().over(Window.partitionBy("sym_id").orderBy("sym_id")).cast("long").alias("seq"),
    ).orderBy(F.desc("confidence"), "file", "line")
