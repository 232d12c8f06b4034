"""From a workspace to its code graph: scan, extract, resolve, edges; written as a snapshot that the next run builds upon."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlight.extract.facts import FACTS, extract_files, tables
from arborlight.extract.packs import PACKS, Pack
from arborlight.functions.scalar import tokens
from arborlight.operators.edges import build_edges
from arborlight.operators.resolve import resolve_imports
from arborlight.plans.durable import Scratch

#: Snapshots of another format are built anew.
FORMAT = "2"
MOST_TOKENS = 50_000


def mention_facts(files: DataFrame) -> DataFrame:
    """Facts of files that are read for their words alone (kind html or text): strings and nothing else."""
    empty = {c.split()[0]: c for c in ("symbols", "refs", "imports")}
    types = dict(x for x in ((f.name, f.dataType.simpleString()) for f in _schema(files.sparkSession)))
    return files.select("path", F.col("kind").alias("lang"), F.lit(False).alias("is_test"), F.lit(False).alias("is_generated"), F.lit("ok").alias("parse_status"), F.array().cast("array<string>").alias("dynamic"),
                        *[F.array().cast(types[c]).alias(c) for c in empty], F.array_sort(F.slice(tokens(F.col("text")), 1, MOST_TOKENS)).alias("strings"))


def _schema(spark: SparkSession):
    return spark.createDataFrame([], FACTS).schema


def graph_of(facts: DataFrame, packages: DataFrame, scratch: Scratch) -> dict[str, DataFrame]:
    """The graph's tables from facts of files: ids, resolved imports, edges."""
    t = {k: scratch.save(v) for k, v in tables(facts).items()}
    t["imports"] = scratch.save(resolve_imports(t["imports"], t["files"].select("path", "lang"), packages))
    ids = t["files"].select(F.col("path").alias("_p"), F.col("file_id").alias("target_id"))
    # a row for each imported file, and rows for names: what is imported by name counts for more
    met = t["imports"].select("file_id", F.explode("resolved_files").alias("_p")).join(ids, "_p").select("file_id", "target_id", F.lit(None).cast("string").alias("name"))
    named = t["imports"].select("file_id", F.lit(None).cast("long").alias("target_id"), F.explode("names").alias("name"))
    edges = build_edges(t["refs"], t["symbols"], met.unionByName(named))
    t["edges"] = scratch.save(edges.withColumn("source", F.lit("t0-treesitter")))
    return t


def files_per_language(files: DataFrame) -> DataFrame:
    """(lang, files, size) of files(lang, size)."""
    return files.groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("long").alias("size"))


def changed_facts(spark: SparkSession, scanned: DataFrame, before: DataFrame | None, packs: dict[str, Pack] = PACKS) -> DataFrame:
    """Facts of scanned(path, lang, kind, hash, text, ...): those of equal path and hash are taken from before, the rest extracted."""
    f = scanned if before is None else scanned.join(before.select("path", "hash"), ["path", "hash"], "left_anti")
    names = [x for x in _schema(spark).names]
    new = extract_files(f.where("kind = 'source'"), packs).unionByName(mention_facts(f.where("kind <> 'source' and text is not null")))
    new = new.join(f.select("path", "hash", "size"), "path")
    if before is None:
        return new
    kept = before.join(scanned.select("path", "hash"), ["path", "hash"], "left_semi").select(*names, "hash", "size")
    return new.select(*names, "hash", "size").unionByName(kept)


class Store:
    """Snapshots of facts and graphs in a folder that the cluster shares; a pointer names the one that counts.

    A new snapshot is written beside the old one and the pointer is replaced last, so readers always see a whole one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def meta(self) -> dict | None:
        p, fs = self._fs(f"{self.root}/current.json")
        if not fs.exists(p):
            return None
        d = json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/current.json").collect()))
        return d if d.get("format") == FORMAT else None

    def load(self) -> dict[str, DataFrame] | None:
        """facts, files, symbols, refs, imports, strings and edges of the current snapshot; lazy and pruned by column."""
        m = self.meta()
        return {t: self.spark.read.parquet(f"{self.root}/{m['snapshot']}/{t}") for t in m["tables"]} if m else None

    def write(self, made: dict[str, DataFrame], **more) -> None:
        m = self.meta()
        name = f"snapshot-{(m['number'] if m else 0) + 1}"
        for t, df in made.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/{t}")
        meta = {"format": FORMAT, "number": (m["number"] if m else 0) + 1, "snapshot": name, "tables": sorted(made), **more}
        p, fs = self._fs(f"{self.root}/current.json.new")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        goal, _ = self._fs(f"{self.root}/current.json")
        fs.delete(goal, False)
        fs.rename(p, goal)
        if m:
            fs.delete(self._fs(f"{self.root}/{m['snapshot']}")[0], True)

    def update(self, scanned: DataFrame, packages: DataFrame, stamp: Callable[[], str] | str = "", packs: dict[str, Pack] = PACKS) -> dict[str, DataFrame]:
        """Bring the snapshot up to a scan: unchanged files keep their facts; without any change, and with the manifests' stamp
        as it was, nothing is resolved again."""
        stamp = stamp() if callable(stamp) else stamp
        old, m = self.load(), self.meta()
        scratch = Scratch(self.spark, "index")
        scanned = scratch.save(scanned)
        if old is not None and m.get("stamp") == stamp:
            now, was = scanned.where("kind = 'source' or text is not null").select("path", "hash"), old["facts"].select("path", "hash")
            if now.exceptAll(was).isEmpty() and was.exceptAll(now).isEmpty():
                return old
        facts = scratch.save(changed_facts(self.spark, scanned, old and old["facts"], packs))
        self.write({"facts": facts, **graph_of(facts.drop("hash", "size"), packages, scratch)}, stamp=stamp)
        return self.load()
