"""Set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tagged_union(left: DataFrame, right: DataFrame, tag: str = "tid") -> DataFrame:
    """All rows of both, tagged 1 and 2; columns that one side lacks are null."""
    return left.withColumn(tag, F.lit(1)).unionByName(right.withColumn(tag, F.lit(2)), allowMissingColumns=True)


def distinct_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.select(*(columns or df.columns)).distinct()


def unprobed(rows: DataFrame, key: str, probes: DataFrame, probe_key: str) -> DataFrame:
    """Rows whose key no probe has."""
    keys = probes.select(F.col(probe_key).alias("__p")).distinct()
    return rows.join(keys, F.col(key) == F.col("__p"), "left_anti")
