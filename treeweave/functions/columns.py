"""Predicates, sampling and key encoding for workload preparation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the sample buckets: Knuth's multiplier, 32 bits, percent.
MULTIPLIER, LOW_BITS, BUCKETS = 2_654_435_761, 0xFFFFFFFF, 100


def sample_bucket(key: Column) -> Column:
    """0..99. Only the low 32 bits of the key matter, which keeps the product inside 64 bits and the result right for any long."""
    low = key.cast("long").bitwiseAND(F.lit(LOW_BITS))
    # low * MULTIPLIER mod 2**32 from two 16-bit halves
    high = F.shiftrightunsigned(low, 16) * F.lit(MULTIPLIER)
    product = F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16) + low.bitwiseAND(F.lit(0xFFFF)) * F.lit(MULTIPLIER)
    return product.bitwiseAND(F.lit(LOW_BITS)) % F.lit(BUCKETS)


def in_sample(key: Column, percent: int) -> Column:
    """Nested: what is in a smaller sample is in every larger one."""
    return sample_bucket(key) < F.lit(percent)


def contains_any(text: Column, parts: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def like_filter(text: Column, any_of: Iterable[str] = (), none_of: Iterable[str] = ()) -> Column:
    """At least one of any_of (if given) and nothing of none_of."""
    any_of = list(any_of)
    keep = contains_any(text, any_of) if any_of else F.lit(True)
    return keep & ~contains_any(text, none_of)


def dense_ids(pairs: DataFrame, key: Sequence[str], name: str = "pair_id") -> DataFrame:
    """Distinct keys with ids 0, 1, ... in key order; null parts make no key.

    The numbering goes through range partitions, so no task sees all keys. Joins need no such ids: join_on takes several columns.
    """
    from ..operators.scans import global_position

    keys = pairs.select(*key).dropna().distinct()
    return global_position(keys, list(key), name)


def duplicated(df: DataFrame, column: str, name: str) -> DataFrame:
    """A payload column that repeats a key."""
    return df.withColumn(name, F.col(column))


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows of each group in a total order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")
