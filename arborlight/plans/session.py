"""Session settings that the plans here are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "arborlight") -> SparkSession:
    """A local session; on a cluster pass your own, all functions take any."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
