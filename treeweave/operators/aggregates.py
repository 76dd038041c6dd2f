"""Counting: by key, by group and side, largest frequency, distribution of frequencies, bag fingerprint."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sets import tagged_union


def reduce_by_key(df: DataFrame, key: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias(name))


def group_sizes(left: DataFrame, right: DataFrame, key: Sequence[str], names: tuple[str, str] = ("n_left", "n_right")) -> DataFrame:
    """Rows of both sides, tagged 1 and 2, each with how many rows of either side its key has."""
    both = tagged_union(left, right)
    sizes = both.groupBy(*key).agg(F.count_if(F.col("tid") == 1).alias(names[0]), F.count_if(F.col("tid") == 2).alias(names[1]))
    return both.join(sizes, list(key))


def max_frequency(df: DataFrame, columns: Sequence[str], name: str = "max_frequency") -> DataFrame:
    """Most rows that agree in the columns; the number of rows for no columns. One row; 0 for an empty table."""
    if not columns:
        return df.agg(F.count("*").alias(name))
    return df.groupBy(*columns).agg(F.count("*").alias("__n")).agg(F.coalesce(F.max("__n"), F.lit(0)).alias(name))


def frequency_stats(df: DataFrame, key: str) -> DataFrame:
    """gini, max_frequency and n_keys of a key's frequencies. One row.

    sum(i * f) over ascending frequencies needs no sort of the keys: keys of equal frequency f fill a run of ranks, so
    the number of keys by frequency is enough, which has few rows.
    """
    runs = df.groupBy(key).agg(F.count("*").alias("f")).groupBy("f").agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.orderBy("f")) - F.col("k")
    runs = runs.withColumn("w", F.col("f") * (F.col("k") * before + F.col("k") * (F.col("k") + 1) / 2))
    n, total = F.sum("k"), F.sum(F.col("f") * F.col("k"))
    return runs.agg((2.0 * F.sum("w") / (n * total) - (n + 1.0) / n).alias("gini"), F.max("f").alias("max_frequency"), n.alias("n_keys"))


def bag_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """rows, hash_sum, hash_mixed: equal for equal bags of rows, whatever their order. One row."""
    h = F.xxhash64(*(columns or df.columns)).cast("decimal(38,0)")
    low = F.pmod(F.xxhash64(F.lit(1), *(columns or df.columns)), F.lit(1 << 31)).cast("decimal(12,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(h).alias("hash_sum"), F.sum(F.pmod(F.xxhash64(*(columns or df.columns)), F.lit(1 << 31)).cast("decimal(12,0)") * low).alias("hash_mixed"))


def product_count(counts: Sequence[DataFrame], key: str, name: str = "n") -> DataFrame:
    """Sum over keys of the product of each table's rows for the key. One row."""
    per = [d.groupBy(key).agg(F.count("*").alias(f"c{i}")) for i, d in enumerate(counts)]
    joined = reduce(lambda a, b: a.join(b, key), per)
    product: Column = reduce(lambda a, b: a * b, [F.col(f"c{i}") for i in range(len(per))])
    return joined.agg(F.coalesce(F.sum(product), F.lit(0)).alias(name))


def distinct_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """n_<column> for each column: its distinct values. One row."""
    return df.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])
