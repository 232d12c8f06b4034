"""Durable intermediates: tables written to the folder that all executors share.

A written table cuts the lineage like a checkpoint, but is computed once, is columnar and compressed,
and survives the loss of any executor. The folder is ``spark.checkpoint.dir``; only where that is unset
(tests, a laptop) a temporary folder takes its place; on a cluster that would lose data, so there it is an error.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_COLLECTING: list[list[Scratch]] = []


@contextlib.contextmanager
def scratches():
    """The list of all Scratch folders that are made inside, for whoever knows when nothing reads them any more."""
    made: list[Scratch] = []
    _COLLECTING.append(made)
    try:
        yield made
    finally:
        _COLLECTING.remove(made)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, read from the session."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="arborlight-")
    return _LOCAL[app]


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Tables that one query writes; each may be dropped as soon as nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/arborlight/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self._delete_on_exit()
        for made in _COLLECTING:
            made.append(self)

    def _path(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _delete_on_exit(self) -> None:
        p, fs = self._path(self.root)
        fs.mkdirs(p)
        fs.deleteOnExit(p)

    def save(self, df: DataFrame) -> DataFrame:
        """Write df once and return the written table."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def save_by(self, df: DataFrame, key: str) -> DataFrame:
        """Write df, which must be dealt by repartition(buckets(spark), key), in these buckets: joins and groups on the key don't deal it anew."""
        self.count += 1
        path, name = f"{self.root}/{self.count}", f"arborlight_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(buckets(self.spark), key).option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        out._scratch_path, out._scratch_table = path, name
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that save() or save_by() returned."""
        if getattr(df, "_scratch_table", None):
            self.spark.sql(f"drop table if exists {df._scratch_table}")
        p, fs = self._path(df._scratch_path)
        fs.delete(p, True)

    def clear(self) -> None:
        """Delete all tables."""
        p, fs = self._path(self.root)
        fs.delete(p, True)
