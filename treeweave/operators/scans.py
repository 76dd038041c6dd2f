"""Scans: prefix and suffix sums, group totals, forward fill, numbering.

Groups are window partitions, as long as none has more than HOT rows. Beyond, rows are laid out in range partitions of key and order, so that
a hot group lies over many of them: each part of a group is scanned on its own, and what the parts before it add up to follows. The
results are the same. The order must be total for a fixed result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import Workspace
from .shape import with_numbers

HOT = 2_000_000  #: rows of a group that one task scans


def _by(keys: Sequence[str], order: Sequence[Column | str]):
    return Window.partitionBy(*keys).orderBy(*order)


def _scan(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str, frame: tuple[int, int], value: Callable[[Column | str], Column], source: Column, join: Callable[[Column, Column], Column], back: bool = False) -> DataFrame:
    """df with `name`: value(source), an aggregate, over a frame of each row's group.

    value also makes one of the values of a group's parts before a part (back: behind it), and join puts that together with the value inside.
    """
    small = df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > HOT).isEmpty()
    if small:
        return df.withColumn("__in", value(source).over(_by(keys, order).rowsBetween(*frame))).withColumn(name, join(F.lit(None), F.col("__in"))).drop("__in")
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(n, *keys, *order).withColumn("__part", F.spark_partition_id())
    parts = Workspace(spark, "scan").write(laid, "parts")
    here = _by(["__part", *keys], order)
    parts = parts.withColumn("__in", value(source).over(here.rowsBetween(*frame))).withColumn("__all", value(source).over(here.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    names = [f"__k{i}" for i in range(len(keys))]
    each = parts.groupBy("__part", *[F.col(k).alias(a) for k, a in zip(keys, names)]).agg(F.first("__all").alias("__all"))
    w = Window.partitionBy(*names).orderBy("__part")
    w = w.rowsBetween(1, Window.unboundedFollowing) if back else w.rowsBetween(Window.unboundedPreceding, -1)
    carry = each.select("*", value("__all").over(w).alias("__carry"), F.count("*").over(w).alias("__n")).filter("__n > 0").drop("__n", "__all").withColumnRenamed("__part", "__p")
    # a group goes on from the partition before it in one case a partition at most: carry has under n rows
    on = [F.col("__part") == F.col("__p"), *[F.col(k).eqNullSafe(F.col(a)) for k, a in zip(keys, names)]]
    return parts.join(F.broadcast(carry), on, "left").withColumn(name, join(F.col("__carry"), F.col("__in"))).select(*df.columns, name)


def _sum(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[Column | str], name: str, frame: tuple[int, int], back: bool) -> DataFrame:
    return _scan(df, keys, order, name, frame, F.sum, F.col(value), lambda carry, own: F.coalesce(carry + own, carry, own, F.lit(0)), back)


def prefix_sum(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[Column | str], name: str, inclusive: bool = False) -> DataFrame:
    """Sum of the rows before each row of its group (and its own, if inclusive)."""
    return _sum(df, value, keys, order, name, (Window.unboundedPreceding, 0 if inclusive else -1), back=False)


def suffix_sum(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[Column | str], name: str, inclusive: bool = True) -> DataFrame:
    return _sum(df, value, keys, order, name, (0 if inclusive else 1, Window.unboundedFollowing), back=True)


def suffix_product(columns: Sequence[Column]) -> list[Column]:
    """For each column the product of those after it; 1 for the last. The strides of mixed-radix numbers with these digits."""
    out, product = [], F.lit(1).cast("long")
    for c in reversed(columns):
        out.append(product)
        product = product * c
    return out[::-1]


def group_total(df: DataFrame, value: str, keys: Sequence[str], name: str) -> DataFrame:
    """Every row learns its group's sum. The sums are made before they meet the rows, so a hot group is not one task's."""
    sums = df.groupBy(*keys).agg(F.sum(value).alias(name))
    renamed = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], name)
    on = [df[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]
    return df.join(renamed, on).select(*[df[c] for c in df.columns], name)


def forward_fill(df: DataFrame, values: Sequence[str], header: Column, keys: Sequence[str], order: Sequence[Column | str], prefix: str = "filled_") -> DataFrame:
    """Values of the last header row at or before each row of its group."""
    last = lambda c: F.last(c, ignorenulls=True)
    filled = _scan(df, keys, order, "__last", (Window.unboundedPreceding, 0), last, F.when(header, F.struct(*values)), lambda carry, own: F.coalesce(own, carry))
    return filled.select(*df.columns, *[F.col(f"__last.{v}").alias(prefix + v) for v in values])


def rank_offset(df: DataFrame, key: Sequence[str], delta: str | None, order: Sequence[Column | str], name: str = "h") -> DataFrame:
    """Exclusive running delta within the key; a row's number from 0 where no delta is given (leaves)."""
    if delta is None:
        return prefix_sum(df.withColumn("__one", F.lit(1).cast("long")), "__one", key, order, name).drop("__one")
    return prefix_sum(df, delta, key, order, name)


def number_copies(df: DataFrame, name: str = "copy", modulo: int | None = None) -> DataFrame:
    """1, 2, ... among rows equal in all columns; with modulo, starting again after so many.

    Equal rows are counted, which partial sums do before the shuffle, and made again with their numbers: a row that fills a third of the table is no hot task.
    """
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("__times"))
    n = F.col("__number")
    made = with_numbers(counted, F.lit(1), F.col("__times"), "__number")
    return made.select(*df.columns, (n if modulo is None else (n - 1) % modulo + 1).cast("int").alias(name))


def aligned_position(index: Column, first: Column, second: Column) -> Column:
    """Place of entry `index` of a group of first * second entries, dealt so that each of the first meets each of the second."""
    return F.floor(index / first).cast("long") + (index % first) * second


def global_prefix(df: DataFrame, value: Column, order: Sequence[str], name: str, partitions: int | None = None) -> DataFrame:
    """Exclusive running sum over all rows in the order of the columns `order`.

    Range partitions are summed on their own; the sums' prefix, one row a partition, is added. Rows equal in `order` lie in one
    partition. The partitioned rows are written, as the partition numbers are read twice.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    work = Workspace(spark, "prefix")
    parts = work.write(df.withColumn("__v", value.cast("long")).repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "parts")
    sums = parts.groupBy("__part").agg(F.sum("__v").alias("__n"))
    before = sums.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = F.sum("__v").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = parts.withColumn("__in", F.coalesce(inside, F.lit(0))).join(F.broadcast(before), "__part")  # one row for each of n partitions
    return out.withColumn(name, F.col("__before") + F.col("__in")).select(*df.columns, name)


def global_position(df: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    return global_prefix(df, F.lit(1), order, name)
