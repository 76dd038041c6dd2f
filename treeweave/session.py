"""A session with the settings this package is made for. A running session is used as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(threads: int | None = None, **settings: str) -> SparkSession:
    """On a cluster leave threads out; master and memory then come from spark-submit."""
    if (active := SparkSession.getActiveSession()) is not None:
        return active
    builder = SparkSession.builder.appName("treeweave")
    if threads:
        builder = builder.master(f"local[{threads}]").config("spark.sql.shuffle.partitions", str(2 * threads))
    conf = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.cbo.enabled": "true", "spark.ui.showConsoleProgress": "false",
    } | settings
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
