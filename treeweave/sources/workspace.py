"""Written intermediates in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Workspace:
    """Tables written under the folder that spark.checkpoint.dir names, which driver and executors share.

    A written table cuts the lineage: after the loss of an executor Spark reads files again instead of recomputing the plan.
    Without the setting a local session gets a temporary folder; for a cluster session that is an error.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="treeweave-")
            spark.sparkContext.setCheckpointDir(base)
        self.spark, self.path = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{tag}")
        return self.read(df, tag)

    def read(self, like: DataFrame, tag: str) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{tag}")

    def drop(self, tag: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{tag}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
