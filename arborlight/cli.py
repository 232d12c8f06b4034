"""The command line: index, dead-code, check-deps, weakening, find, refs, diagnostics, scip, map, impact, verify.

Exit codes: 0 nothing found that trips, 1 tripped, 2 an error.
"""

from __future__ import annotations

import argparse
import hashlib
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlight import gate, render
from arborlight.functions.scalar import LEVELS, rank_of
from arborlight.index import Store
from arborlight.operators import dependencies, mapping, relations, weakening
from arborlight.operators.deadcode import AllowList, dead_code
from arborlight.operators.hosts import merged_hosts
from arborlight.operators.precise import apply_index
from arborlight.plans.session import session
from arborlight.sources import changes, manifests, reports, scip, workspace


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="arborlight", description="Code-graph analytics and a change gate on Spark")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str):
        c = sub.add_parser(name, help=about)
        c.add_argument("path", nargs="?", default=".")
        c.add_argument("--store", help="folder of snapshots; default <path>/.arborlight")
        c.add_argument("--format", choices=("text", "json"), default="text")
        c.add_argument("--max", type=int, default=100)
        c.add_argument("--fail-on", choices=LEVELS)
        return c

    command("index", "bring the snapshot up to date")
    c = command("dead-code", "symbols that nothing live reaches")
    c.add_argument("--min-confidence", type=float, default=0.70)
    c.add_argument("--lib", action="store_true")
    c.add_argument("--prefix", default="")
    c.add_argument("--allow")
    c.add_argument("--scip", action="store_true")
    c = command("check-deps", "imports that no manifest declares")
    c.add_argument("--online", action="store_true")
    c.add_argument("--prefix", default="")
    c = command("weakening", "tests that a diff weakens")
    c.add_argument("--base", required=True)
    c.add_argument("--head")
    c = command("find", "symbols by name")
    c.add_argument("query")
    c = command("refs", "references to a symbol")
    c.add_argument("symbol")
    c = command("diagnostics", "reports of tools, saved or run")
    c.add_argument("--input", action="append", default=[], metavar="TOOL=FILE")
    c.add_argument("--run", action="store_true")
    c.add_argument("--min-severity", choices=("info", "warning", "error"), default="info")
    command("scip", "coverage of code indexes")
    c = command("map", "the symbols that matter most, within a budget")
    c.add_argument("--budget", type=int, default=1000)
    c.add_argument("--changed", metavar="REV")
    c = command("impact", "what depends on symbols or on a change")
    c.add_argument("--symbol", action="append", default=[])
    c.add_argument("--base")
    c.add_argument("--depth", type=int, default=4)
    c = command("verify", "all steps against the baseline")
    c.add_argument("--base")
    c.add_argument("--baseline", default="baseline.json")
    c.add_argument("--trusted-commit")
    c.add_argument("--update-baseline", action="store_true")
    return p


def _allow(root: str, extra: str | None) -> AllowList:
    found = AllowList()
    for path in (os.path.join(root, ".arborlight", "allow.toml"), extra):
        if path and os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                a = AllowList.parse(f.read())
            found = AllowList(found.symbols + a.symbols, found.deps + a.deps)
    return found


def _graph(spark: SparkSession, args) -> dict[str, DataFrame]:
    store = Store(spark, args.store or os.path.join(os.path.abspath(args.path), ".arborlight", "store"))
    packages = manifests.scan_packages(spark, args.path)
    stamp = hashlib.sha256(repr(sorted(tuple(map(str, r)) for r in packages.collect())).encode()).hexdigest()
    return store.update(workspace.scan_workspace(spark, os.path.abspath(args.path)), packages, stamp=stamp)


def _dead(spark, args, graph) -> DataFrame:
    more = {}
    if getattr(args, "scip", False) and (paths := scip.discover(args.path)):
        made = apply_index(graph, scip.read_scip(spark, *paths))
        graph, more = graph | {"edges": made["edges"]}, {"precise": made["precise"], "precise_refs": made["precise_refs"]}
    return dead_code(graph, _allow(args.path, getattr(args, "allow", None)), getattr(args, "lib", False), prefix=getattr(args, "prefix", ""), least=getattr(args, "min_confidence", 0.70), merged=merged_hosts(graph), **more)


def _deps(spark, args, graph) -> DataFrame:
    m = manifests.scan_packages(spark, args.path)
    registry = dependencies.HttpRegistry(os.path.join(args.path, ".arborlight", "registry.json")) if getattr(args, "online", False) else dependencies.Offline()
    return dependencies.check_dependencies(dependencies.graph_imports(graph), manifests.scan_manifests(spark, args.path), m, m, registry, getattr(args, "prefix", ""), allow=_allow(args.path, None))[0]


def _show(df: DataFrame, args) -> None:
    rows = [r.asDict() for r in df.limit(args.max).collect()]
    print(render.pretty({"rows": rows}) if args.format == "json" else "\n".join("  ".join(f"{v}" for v in r.values()) for r in rows))


def run(spark: SparkSession, argv: list[str]) -> int:
    """The command's exit code; its report goes to standard output."""
    args = _parser().parse_args(argv)
    c = args.command
    found = None
    if c == "weakening":
        found = weakening.analyze_diff(changes.diff_lines(spark, args.path, args.base, args.head))
    elif c == "diagnostics":
        inputs = {}
        for item in args.input:
            tool, _, path = item.partition("=")
            with open(changes.safe_path(args.path, path), encoding="utf-8") as f:
                inputs[tool] = f.read()
        found, status = reports.collect(spark, inputs, args.path, args.run, args.min_severity)
        if any(v.startswith("incomplete") for v in status.values()):
            raise ValueError("; ".join(f"{k}: {v}" for k, v in status.items()))
    elif c == "verify":
        graph = _graph(spark, args)
        steps = {"dead-code": lambda: _dead(spark, args, graph), "check-deps": lambda: _deps(spark, args, graph), "weakening": (lambda: weakening.analyze_diff(changes.diff_lines(spark, args.path, args.base))) if args.base else None}
        base = gate.read_baseline(spark, args.path, args.baseline, args.trusted_commit)
        update = (lambda e: gate.write_baseline(e, args.path, args.baseline)) if args.update_baseline else None
        report = gate.verify(spark, steps, base, update=update)
        print(render.pretty({"verdict": report.verdict, "counts": report.counts, "notes": report.notes, **render.capped(report.new.drop("fp"), args.max)}) if args.format == "json" else f"{report.verdict}: {report.counts}")
        return {"pass": 0, "baseline-updated": 0, "fail": 1}.get(report.verdict, 2)
    else:
        graph = _graph(spark, args)
        named = graph["symbols"].join(graph["files"].select("file_id", F.col("path").alias("file")), "file_id")
        if c == "index":
            print({t: df.count() for t, df in graph.items()}, {r.lang: r["count"] for r in graph["files"].groupBy("lang").count().collect()})
        elif c == "dead-code":
            found = _dead(spark, args, graph)
        elif c == "check-deps":
            found = _deps(spark, args, graph)
        elif c == "find":
            _show(relations.search(named.select("sym_id", "name", "file", F.col("start_line").alias("line")), args.query, args.max), args)
        elif c == "refs":
            edges = graph["edges"].select(F.col("src_sym").alias("src"), F.col("dst_sym").alias("dst"), "line", F.col("confidence").alias("conf"))
            _show(relations.incoming(edges, named.select(F.col("sym_id").alias("id"), "name", "file"), [args.symbol], args.max), args)
        elif c == "scip":
            paths = scip.discover(args.path)
            _show(apply_index(graph, scip.read_scip(spark, *paths))["coverage"], args) if paths else print("no index")
        elif c == "map":
            focus = changes.changed_files(args.path, args.changed) if args.changed else None
            texts = workspace.scan_workspace(spark, os.path.abspath(args.path)).select("path", "text")
            _show(mapping.repo_map(graph, texts, args.budget, focus).select("path", "line", "text"), args)
        elif c == "impact":
            seeds = mapping.range_seeds(graph, changes.changed_ranges(spark, args.path, args.base)) if args.base else mapping.symbol_seeds(graph, args.symbol)
            callers, module, affected = mapping.impact(graph, seeds, args.depth)
            _show(callers.drop("sym_id"), args)
            _show(affected, args)
    if found is None:
        return 0
    found = found.cache()
    report = render.capped(found, args.max)
    print(render.pretty(report) if args.format == "json" else render.text(report))
    return int(bool(args.fail_on) and not found.where(rank_of(F.col("level"), LEVELS) >= LEVELS.index(args.fail_on)).isEmpty())


def main() -> int:
    spark = session(app="arborlight-cli")
    spark.sparkContext.setLogLevel("ERROR")
    try:
        return run(spark, sys.argv[1:])
    except (ValueError, OSError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except BrokenPipeError:
        return 141


if __name__ == "__main__":
    sys.exit(main())
