"""Files of a workspace as rows, read where the executors are."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlight.functions.paths import language_of, text_kind
from arborlight.functions.scalar import content_hash
from arborlight.operators.relations import ancestors

# Folders that hold no source of the workspace's own. Hidden folders are left out as well.
SKIPPED = ["node_modules", "target", "vendor", "dist", "build", "__pycache__", "venv", "site-packages", "coverage"]
MOST_SOURCE, MOST_TEXT = 2 << 20, 512 << 10
VERSION = "1"


def ignore_rules(folder: str, text: str) -> list[tuple[str, bool]]:
    """(expression over paths, whether it takes back) of an ignore file in a folder ('' for the root), in its order."""
    out, base = [], re.escape(folder + "/") if folder else ""
    for line in text.splitlines():
        line = line.rstrip("\n").rstrip()
        if not line or line.startswith("#"):
            continue
        back = line.startswith("!")
        line = line[1:] if back else line.removeprefix("\\")
        only_folders, line = line.endswith("/"), line.rstrip("/")
        anchored, line = "/" in line, line.removeprefix("/")
        body = ""
        for part in re.split(r"(\*\*/|/\*\*|\*|\?|\[[^\]]*\])", line):
            body += {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(part) or (part.replace("[!", "[^") if part.startswith("[") and part.endswith("]") else re.escape(part))
        if line:
            out.append((f"^{base}{'' if anchored else '(?:.*/)?'}{body}{'/.*' if only_folders else '(?:/.*)?'}$", back))
    return out


def _ignored(spark: SparkSession, root: str, files: DataFrame) -> Column:
    """Whether the ignore files in the folders of files(path) leave a path out: the last rule that matches counts, those of inner folders come later."""
    jvm = spark.sparkContext._jvm
    folders = files.select(F.explode(ancestors(F.col("path"))).alias("d")).where(~F.concat(F.lit("/"), "d").rlike(r"/\.")).distinct()
    out = F.lit(False)
    for folder in sorted((r.d for r in folders.collect()), key=lambda d: (d.count("/") + bool(d), d)):
        p = jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}/.gitignore" if folder else f"{root}/.gitignore")
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(p):
            for pattern, back in ignore_rules(folder, jvm.org.apache.commons.io.IOUtils.toString(fs.open(p), "UTF-8")):
                out = F.when(F.col("path").rlike(pattern), not back).otherwise(out)
    return out


def scan_workspace(spark: SparkSession, root: str) -> DataFrame:
    """(path, lang, kind, size, hash, status, text) of each source file and each file read for mentions alone.

    Sources over 2 MiB have a status and no text; mention files over 512 KiB are left out, and so is what .gitignore files name. hash
    covers version, language and bytes; of a file that is too large, its size and time instead, so its bytes aren't read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    top = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/")
    bare = lambda c: F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")
    start = "/" + top.split(":", 1)[-1].lstrip("/")
    f = files.withColumn("path", F.substring(bare(F.col("path")), len(start) + 2, 1 << 30))
    f = f.where(~_ignored(spark, root, f.select("path")))
    f = f.where(~F.concat(F.lit("/"), F.col("path")).rlike(r"/(?:\.[^/]*|" + "|".join(SKIPPED) + r")/|/\.[^/]*$"))
    f = f.withColumns({"lang": language_of(F.col("path")), "mention": text_kind(F.col("path"))})
    f = f.where(F.col("lang").isNotNull() | (F.col("mention").isNotNull() & (F.col("length") <= MOST_TEXT)))
    large = F.col("length") > MOST_SOURCE
    return f.select(
        "path", "lang", F.when(F.col("lang").isNotNull(), "source").otherwise(F.col("mention")).alias("kind"), F.col("length").alias("size"),
        content_hash(VERSION, F.col("lang"), F.when(large, F.encode(F.concat_ws(" ", "length", F.col("modificationTime").cast("string")), "utf-8")).otherwise(F.col("content"))).alias("hash"),
        F.when(large, "error: skipped, too large").otherwise("ok").alias("status"), F.when(~large, F.decode("content", "utf-8")).alias("text"),
    )
