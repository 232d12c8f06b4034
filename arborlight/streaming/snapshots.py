"""Incremental indexing as a stream: new snapshot files are compared with the state, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arborlight.operators.relations import changed


def watch(spark: SparkSession, folder: str, state: Callable[[], DataFrame], apply: Callable[[DataFrame, DataFrame], None], checkpoint: str):
    """Starts a query over Parquet snapshots (path, hash) that arrive in the folder.

    For each batch, state() gives the stored snapshot and apply(changes, batch) takes (path, change) and the rows; a
    batch that is run again after a failure finds its changes applied and has none.
    """

    def batch(df: DataFrame, _: int) -> None:
        seen = df.select("path", "hash").dropDuplicates(["path"])
        known = state().join(seen.select("path"), "path", "left_semi")
        apply(changed(known, seen), df)

    stream = spark.readStream.schema("path string, hash string, text string").parquet(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
