"""Row shaping: sorting, compaction, expansion, padding, limits, column order, zipping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALID = "__valid"
BLOCK = 65_536  #: copies of a row that are held as one array


def sort_rows(df: DataFrame, columns: Sequence[str], ascending: bool = True, nulls_last: bool = True) -> DataFrame:
    """One direction for all columns; nulls, which stand for absent rows, at the end."""
    one = (lambda c: F.col(c).asc_nulls_last()) if ascending and nulls_last else (lambda c: F.col(c).asc_nulls_first()) if ascending else (lambda c: F.col(c).desc_nulls_last()) if nulls_last else (lambda c: F.col(c).desc_nulls_first())
    return df.orderBy(*[one(c) for c in columns])


def compact(df: DataFrame, mark: Column) -> DataFrame:
    """Only the marked rows. Order is no property of a DataFrame; number rows before if it matters."""
    return df.filter(mark)


def with_numbers(df: DataFrame, start: Column, count: Column, name: str) -> DataFrame:
    """Each row `count` times (none for 0 or less), with the numbers from start on. Numbers are made block by block, so that a row with very many copies is never one array."""
    block, at = "__block", "__start"
    blocks = df.withColumns({at: start.cast("long"), "__count": count.cast("long")}).filter("__count > 0")
    blocks = blocks.withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__count") - 1) / BLOCK))))
    low, high = F.col(block) * BLOCK, F.least((F.col(block) + 1) * BLOCK, F.col("__count")) - 1
    return blocks.withColumn(name, F.explode(F.sequence(F.col(at) + low, F.col(at) + high))).drop(block, at, "__count")


def expand(df: DataFrame, count: str, target: int | None = None, index: str | None = None) -> DataFrame:
    """Each row count times (0 allowed). A negative or null count, or a sum other than target, is an error."""
    facts = df.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n"), F.count_if(F.col(count).isNull() | (F.col(count) < 0)).alias("bad")).first()
    if facts.bad:
        raise ValueError(f"{facts.bad} rows have a negative or null count")
    if target is not None and facts.n != target:
        raise ValueError(f"counts add up to {facts.n}, not {target}")
    name = index or "__i"
    out = with_numbers(df, F.lit(0), F.col(count), name)
    return out if index else out.drop(name)


def expand_to(df: DataFrame, weight: str, size: int, order: Sequence[str]) -> DataFrame:
    """Each row weight times, at least once, in order; cut or padded to size rows."""
    out = expand(df.withColumn(weight, F.greatest(F.col(weight), F.lit(1))), weight, index="__i")
    return pad_to(out.orderBy(*order, "__i").limit(size).drop("__i"), size)


def pad_to(df: DataFrame, target: int, valid: str = VALID, strict: bool = False) -> DataFrame:
    """df with `valid` true, and rows of nulls with `valid` false up to target. More rows than target are an error if strict."""
    n = df.count()
    if n > target and strict:
        raise ValueError(f"{n} rows don't fit into {target}")
    spark = df.sparkSession
    rows = df.withColumn(valid, F.lit(True))
    if n >= target:
        return rows
    padding = spark.range(target - n).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema], F.lit(False).alias(valid))
    return rows.union(padding)


def compact_keeping(df: DataFrame, mark: Column, keep: int, order: Sequence[str]) -> DataFrame:
    """The first `keep` marked rows in the order given, padded to `keep`."""
    return pad_to(df.filter(mark).orderBy(*order).limit(keep), keep)


def reorder(df: DataFrame, groups: dict[str, Sequence[str]], order: Sequence[str]) -> DataFrame:
    """Columns by relation, relations in the order given."""
    return df.select(*[c for r in order for c in groups[r]])


def zip_rows(left: DataFrame, right: DataFrame, slot: Sequence[str]) -> DataFrame:
    """Rows of both sides that have the same slot: a key and a number within it."""
    return left.join(right, list(slot))
