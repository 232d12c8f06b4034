"""Dependencies: imports against the manifests above them, and what a registry says of those that none declares."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlight.functions.paths import valid_package
from arborlight.functions.scalar import PYPI_OF_IMPORT, level, normalize_package, sanitize
from arborlight.operators.deadcode import AllowList
from arborlight.operators.relations import ancestors, same_row
from arborlight.operators.resolve import ECOSYSTEM

MOST_LOOKUPS = 300


def norm_for(eco: Column, name: Column) -> Column:
    """The form in which an ecosystem compares names: npm as they are, crates with underscores, PyPI folded."""
    return F.when(eco.isin("crates.io", "crates"), F.translate(F.lower(name), "-", "_")).when(eco == "pypi", normalize_package(name)).otherwise(name)


def relaxed(declared: Column) -> Column:
    """A declared PyPI name without python- and py- before or after it, however often."""
    front = F.regexp_replace(F.regexp_replace(declared, "^(?:python-)+", ""), "^(?:py-)+", "")
    return F.regexp_replace(F.regexp_replace(front, "(?:-python)+$", ""), "(?:-py)+$", "")


def distribution(eco: Column, package: Column) -> Column:
    """The PyPI distribution that an import is known to come from; null where it is not listed."""
    listed = F.create_map(*[F.lit(x) for kv in PYPI_OF_IMPORT.items() for x in kv])
    return F.when(eco == "pypi", F.try_element_at(listed, package))


class Registry(Protocol):
    """Answers whether packages exist: (eco, name) to (eco, name, exists, reason); exists null is unknown, which is not absent."""

    def lookup(self, names: DataFrame) -> DataFrame: ...


class Offline:
    """Knows nothing: nothing is ever reported as absent."""

    def lookup(self, names: DataFrame) -> DataFrame:
        return names.select("eco", "name", F.lit(None).cast("boolean").alias("exists"), F.lit("offline").alias("reason"))


class StaticRegistry:
    """Answers from a table (eco, name, exists); what has no row is unknown."""

    def __init__(self, table: DataFrame):
        self.table = table

    def lookup(self, names: DataFrame) -> DataFrame:
        found = names.join(self.table.select("eco", "name", "exists").dropDuplicates(["eco", "name"]), ["eco", "name"], "left")
        return found.select("eco", "name", "exists", F.when(F.col("exists").isNull(), "no answer").alias("reason"))


class HttpRegistry:
    """Asks registries over HTTP, where the executors may: 200 exists, 404 doesn't, all else is unknown. Names that the ecosystem doesn't
    admit are never sent. Answers are kept in a file on the driver, for a day if definite and an hour if not."""

    URLS = {"pypi": "https://pypi.org/pypi/{}/json", "npm": "https://registry.npmjs.org/{}", "crates.io": "https://crates.io/api/v1/crates/{}"}

    def __init__(self, cache: str | None = None, urls: dict[str, str] | None = None, timeout: float = 10.0):
        self.cache, self.urls, self.timeout = cache, urls or self.URLS, timeout

    def _kept(self) -> dict:
        if not self.cache or not os.path.exists(self.cache):
            return {}
        with open(self.cache, encoding="utf-8") as f:
            return {k: v for k, v in json.load(f).items() if time.time() - v["at"] < (86_400 if v["exists"] is not None else 3_600)}

    def lookup(self, names: DataFrame) -> DataFrame:
        spark, kept, urls, timeout = names.sparkSession, self._kept(), self.urls, self.timeout
        known = spark.createDataFrame([(*k.split("\t"), v["exists"], v["reason"]) for k, v in kept.items()], "eco string, name string, exists boolean, reason string")
        asked = names.withColumn("ok", valid_package(F.col("eco"), F.col("name"))).join(known.select("eco", "name"), ["eco", "name"], "left_anti")

        def ask(batches):
            for b in batches:
                rows = []
                for eco, name, ok in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    exists, reason = None, "invalid name" if not ok else "no registry"
                    if ok and eco in urls:
                        try:
                            with urllib.request.urlopen(urls[eco].format(urllib.request.quote(name, safe="@")), timeout=timeout) as r:
                                exists, reason = (True, None) if r.status == 200 else (None, f"status {r.status}")
                        except urllib.error.HTTPError as e:
                            exists, reason = (False, None) if e.code == 404 else (None, f"status {e.code}")
                        except OSError as e:
                            reason = type(e).__name__
                    rows.append({"eco": eco, "name": name, "exists": exists, "reason": reason})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("eco", pa.string()), ("name", pa.string()), ("exists", pa.bool_()), ("reason", pa.string())]))

        fresh = spark.createDataFrame(asked.select("eco", "name", "ok").mapInArrow(ask, "eco string, name string, exists boolean, reason string").collect(), known.schema)  # at most the lookups' limit
        if self.cache:
            now = {f"{r.eco}\t{r.name}": {"exists": r.exists, "reason": r.reason, "at": time.time()} for r in fresh.collect()}
            with open(f"{self.cache}.new", "w", encoding="utf-8") as f:
                json.dump(kept | now, f)
            os.replace(f"{self.cache}.new", self.cache)
        return fresh.unionByName(known.join(names, ["eco", "name"], "left_semi"))


def is_dev(section: Column) -> Column:
    return section.contains("dev") | section.contains("test") | section.contains("build-system") | (section == "build")


def declared(imports: DataFrame, deps: DataFrame, manifests: DataFrame) -> DataFrame:
    """imports(import_id, file, eco, package, is_test, ...) with declared, dev_only, has_manifest, mapped and reg_name.

    deps(eco, dir, name, section) and manifests(eco, dir) count where their folder is above the file; a null file stands in the root
    folder. All of it depends on file, ecosystem and package alone and is looked up once for each of these; ids need not be unique.
    """
    by = ["file", "eco", "package"]
    up = imports.select(*by).distinct().withColumn("dir", F.explode(ancestors(F.coalesce("file", F.lit("")))))
    mapped = distribution(F.col("eco"), F.col("package"))
    want = norm_for(F.col("eco"), F.col("package"))
    keys = F.array(F.struct(want.alias("key"), F.lit(True).alias("own")), F.struct(normalize_package(mapped).alias("key"), F.lit(False).alias("own")))
    asked = up.select(*by, "dir", F.inline(keys)).where("key is not null").distinct()
    name = norm_for(F.col("eco"), F.col("name"))
    forms = F.array(F.struct(name.alias("key"), F.lit(True).alias("exact")), F.struct(F.when(F.col("eco") == "pypi", relaxed(name)).alias("key"), F.lit(False).alias("exact")))
    offered = deps.select("eco", "dir", is_dev(F.col("section")).alias("dev"), F.inline(forms)).where("key is not null").distinct()
    met = asked.join(offered, ["eco", "dir", "key"]).where("exact or own").groupBy(*by).agg(F.bool_and("dev").alias("all_dev"))
    has = up.join(manifests.select("eco", "dir").distinct(), ["eco", "dir"], "left_semi").select(*by).distinct().withColumn("has_manifest", F.lit(True))
    out = same_row(same_row(imports, met, by), has, by)
    return out.withColumns({
        "declared": F.col("all_dev").isNotNull(), "dev_only": F.coalesce("all_dev", F.lit(False)) & ~F.col("is_test"), "has_manifest": F.coalesce("has_manifest", F.lit(False)),
        "mapped": mapped.isNotNull(), "reg_name": F.coalesce(mapped, F.col("package")),
    }).drop("all_dev")


def import_confidence(absent: Column, eco: Column, mapped: Column, has_manifest: Column, optional: Column) -> Column:
    """Of an undeclared import: by ecosystem and by whether its distribution is known, less without a manifest or in a guard."""
    pypi = eco == "pypi"
    base = F.when(absent, F.when(pypi & ~mapped, 0.70).when(pypi, 0.85).otherwise(0.90)).otherwise(F.when(pypi & ~mapped, 0.55).when(pypi, 0.70).otherwise(0.80))
    base = F.when(~has_manifest, F.least(base, F.lit(0.45))).otherwise(base)
    return F.when(optional, F.least(base, F.lit(0.35))).otherwise(base)


def check_dependencies(
    imports: DataFrame, deps: DataFrame, manifests: DataFrame, packages: DataFrame, registry: Registry | None = None, prefix: str = "", most_lookups: int = MOST_LOOKUPS,
    check_declared: bool = True, allow: AllowList | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(findings, lookups (eco, name, exists, reason)).

    imports(import_id, file, lang, module, line, kind, class, package, is_test, is_generated); deps(eco, dir, manifest_path, name,
    registry_name, section, checkable, line); manifests(eco, dir); packages(eco, name): the project's own. Only the first
    ``most_lookups`` names by ecosystem and name are asked for, the others are unknown; unknown is never reported as absent.
    """
    allow, registry = allow or AllowList(), registry or Offline()
    eco_name = F.when(F.col("eco") == "crates", "crates.io").otherwise(F.col("eco"))
    deps, manifests, packages = (d.withColumn("eco", eco_name) for d in (deps, manifests, packages))
    eco = F.create_map(*[F.lit(x) for kv in ECOSYSTEM.items() for x in kv])
    i = imports.where(F.col("file").startswith(prefix) & ~F.col("is_generated")).withColumn("eco", F.try_element_at(eco, F.col("lang")))
    nothing = F.lit(None).cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    module = sanitize(F.col("module"))
    lost = i.where("class = 'unresolved'").select(F.lit("unresolved-import").alias("rule"), "file", "line", module.alias("symbol"), F.lit("import").alias("kind"), F.lit("error").alias("severity"), F.when(F.col("kind") == "mod", 0.60).otherwise(0.80).alias("confidence"),
                                                  F.lit("t0-import-resolution").alias("source"), text("import `", module, "` does not resolve to any indexed file").alias("message"), nothing.alias("package"))
    x = declared(i.where("class = 'external' and package is not null and eco is not null"), deps, manifests).withColumn("optional", F.col("kind") == "optional")
    own = packages.where("name is not null").select("eco", norm_for(F.col("eco"), F.col("name")).alias("key")).distinct()
    asked = x.where("not declared").select("eco", F.col("reg_name").alias("name"))
    checkable = deps.where("checkable").withColumn("key", norm_for(F.col("eco"), F.col("registry_name"))).join(own, ["eco", "key"], "left_anti")
    if check_declared:
        near = F.col("dir").startswith(prefix) | F.lit(prefix).startswith(F.col("dir"))
        asked = asked.unionByName(checkable.where(near).select("eco", F.col("registry_name").alias("name")))
    asked = asked.distinct()
    first = asked.orderBy("eco", "name").limit(most_lookups)
    answers = registry.lookup(first)
    answers = answers.unionByName(asked.join(first, ["eco", "name"], "left_anti").select("eco", "name", F.lit(None).cast("boolean").alias("exists"), F.lit("lookup cap reached").alias("reason")))
    answers = answers.sparkSession.createDataFrame(answers.collect(), "eco string, name string, exists boolean, reason string") if isinstance(registry, HttpRegistry) else answers
    u = x.where("not declared").join(answers.select("eco", F.col("name").alias("reg_name"), "exists"), ["eco", "reg_name"], "left")
    absent = F.coalesce(~F.col("exists"), F.lit(False))
    name = sanitize(F.col("package"))
    undeclared = u.select(F.when(absent, "nonexistent-package").otherwise("undeclared-dependency").alias("rule"), "file", "line", module.alias("symbol"), F.lit("import").alias("kind"), F.lit("error").alias("severity"),
                          import_confidence(absent, F.col("eco"), F.col("mapped"), F.col("has_manifest"), F.col("optional")).alias("confidence"), F.when(absent, text("registry:", F.col("eco"))).otherwise("manifest+t0-import").alias("source"),
                          F.when(absent, text("`", name, "` is not declared and does not exist on ", F.col("eco"))).otherwise(text("`", name, "` is imported but not declared in a manifest")).alias("message"), "package")
    gone = deps.where("checkable").join(answers.where("not exists").select("eco", F.col("name").alias("registry_name")), ["eco", "registry_name"], "left_semi")
    ghosts = gone.select(F.lit("nonexistent-declared-package").alias("rule"), F.col("manifest_path").alias("file"), "line", sanitize(F.col("name")).alias("symbol"), F.lit("dependency").alias("kind"), F.lit("error").alias("severity"), F.lit(0.90).alias("confidence"),
                         text("registry:", F.col("eco")).alias("source"), text("`", sanitize(F.col("registry_name")), "` is declared but does not exist on ", F.col("eco")).alias("message"), F.col("name").alias("package"))
    dev = x.where("dev_only").select(F.lit("dev-dependency-in-source").alias("rule"), "file", "line", nothing.alias("symbol"), F.lit("import").alias("kind"), F.lit("info").alias("severity"), F.lit(0.5).alias("confidence"), F.lit("manifest+t0-import").alias("source"),
                                     text("`", name, "` is only declared as a dev/build dependency").alias("message"), "package")
    found = lost.unionByName(undeclared).unionByName(ghosts).unionByName(dev)
    found = found.where(~allow.allows_dependency(F.col("file"), F.col("package")))
    found = found.select(F.lit("deps").alias("category"), "rule", "file", "line", "symbol", F.lit(None).cast("long").alias("col"), "kind", "severity", F.round("confidence", 2).alias("confidence"), level(F.col("confidence")).alias("level"), "source", "message",
                         F.array(F.col("message")).alias("evidence"), F.array().cast("array<string>").alias("fp_risks"))
    return found.orderBy(F.desc("confidence"), "file", "line", "rule"), answers


def lookup_counts(lookups: DataFrame) -> DataFrame:
    """One row: how many names were asked for, and how many answers are unknown."""
    return lookups.agg(F.count(F.lit(1)).alias("lookups"), F.count_if(F.col("exists").isNull()).alias("unknown"))


def graph_imports(graph: dict[str, DataFrame]) -> DataFrame:
    """A graph's imports as check_dependencies takes them."""
    return graph["imports"].join(graph["files"].select("file_id", "is_test", "is_generated"), "file_id")


__all__ = ["HttpRegistry", "Offline", "StaticRegistry", "check_dependencies", "declared", "graph_imports", "lookup_counts", "norm_for", "relaxed"]
