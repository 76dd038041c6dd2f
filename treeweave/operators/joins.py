"""Two-way joins and what is built from them. Nulls never match; 0 and the extreme integers are values like others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import forward_fill
from .shape import pad_to, with_numbers

FEW_SLOTS = 200_000  #: slots, or rows whose number is known, that may be broadcast: under about 20 MB


def _condition(left: DataFrame, left_on: Sequence[str], right: DataFrame, right_on: Sequence[str]) -> list[Column]:
    return [left[a] == right[b] for a, b in zip(left_on, right_on, strict=True)]


def _aside(df: DataFrame, on: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """df with its key columns under names that clash with nothing."""
    names = [f"__k{i}" for i in range(len(on))]
    return df.select(*[F.col(c).alias(n) for c, n in zip(on, names)], *[c for c in df.columns if c not in on]), names


def equi_join(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], size: int | None = None) -> DataFrame:
    """Inner join on one or more column pairs, all columns of both sides; with size, cut or padded to so many rows."""
    out = left.join(right, _condition(left, left_on, right, right_on))
    return out if size is None else pad_to(out.limit(size), size)


def semi_join(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str]) -> DataFrame:
    return left.join(right, _condition(left, left_on, right, right_on), "left_semi")


def anti_join(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str]) -> DataFrame:
    return left.join(right, _condition(left, left_on, right, right_on), "left_anti")


def group_join(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], value: str | None = None, name: str = "matched") -> DataFrame:
    """Every left row with the number of its matches, or the sum of their values; 0 without a match. The right side is summed before it is joined."""
    total = F.count("*") if value is None else F.sum(value)
    sums = right.groupBy(*right_on).agg(total.alias(name))
    sums, keys = _aside(sums, right_on)
    return left.join(sums, _condition(left, left_on, sums, keys), "left").select(*[left[c] for c in left.columns], F.coalesce(name, F.lit(0)).alias(name))


def semi_join_counts(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], name: str = "matched") -> DataFrame:
    """As group_join, with the columns of rows without a match set to 0 (numbers) or null."""
    out = group_join(left, right, left_on, right_on, name=name)
    types = dict(left.dtypes)
    blank = lambda c: F.lit(0).cast(types[c]) if types[c] in ("int", "bigint", "smallint", "tinyint", "double", "float") else F.lit(None).cast(types[c])
    return out.select(*[F.when(F.col(name) > 0, F.col(c)).otherwise(blank(c)).alias(c) for c in left.columns], name)


def annotate(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], value: str) -> DataFrame:
    """Left rows that match with the value of their key; right has one row for each key."""
    side, keys = _aside(right.select(*right_on, value), right_on)
    return left.join(side, _condition(left, left_on, side, keys)).select(*[left[c] for c in left.columns], value)


def augment(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str], name: str = "n_matches") -> DataFrame:
    """Left rows that match with the number of their matches."""
    return annotate(left, right.groupBy(*right_on).agg(F.count("*").alias(name)), left_on, right_on, name)


def range_lookup(positions: DataFrame, ranges: DataFrame, key: Sequence[str], position: str, start: str, values: Sequence[str]) -> DataFrame:
    """Each position with the values of the last range of its key that starts at or before it (as-of).

    Both sides are laid over one another and filled forward, so a position meets one range only.
    """
    left = positions.select(*key, F.col(position).alias("__at"), F.lit(1).alias("__side"), F.struct(*positions.columns).alias("__row"), F.lit(None).cast(ranges.select(F.struct(*values).alias("x")).schema["x"].dataType).alias("__v"))
    right = ranges.select(*key, F.col(start).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), F.struct(*values).alias("__v"))
    both = forward_fill(left.unionByName(right), ["__v"], F.col("__side") == 0, key, ["__at", "__side"], "__last")
    return both.filter("__side = 1 AND __last__v IS NOT NULL").select("__row.*", *[F.col(f"__last__v.{v}").alias(v) for v in values])


def align_copies(parents: DataFrame, children: DataFrame, parent_key: Sequence[str], child_key: Sequence[str], order: str, offset: str, weight: str, reduced: bool = False, n_slots: int | None = None) -> DataFrame:
    """Each parent copy with the child that covers its order number: child rows hold [offset, offset + weight) of their key.

    Child rows are spread over their slots, and (key, slot) is joined as equality: a hot key's slots are spread over all tasks.
    Only keys that parents have are spread; children that are reduced to these keys already are taken as they are, and every copy then has its slot.

    Spark takes spread rows for as few as they were before, and would broadcast millions of copies. So the slots are sorted and merged unless n_slots, their number
    or a bound of it, is small; and a left join, which finds the same rows where every copy has its slot, never broadcasts the parents.
    """
    wanted = children if reduced else children.join(parents.select(*[F.col(p).alias(f"__w{i}") for i, p in enumerate(parent_key)]).distinct(), [F.col(c) == F.col(f"__w{i}") for i, c in enumerate(child_key)], "left_semi")
    slots = with_numbers(wanted, F.col(offset), F.col(weight), "__slot")
    few = n_slots is not None and n_slots <= FEW_SLOTS
    on = [F.col(p) == F.col(c) for p, c in zip(parent_key, child_key)]
    return parents.join(slots if few else slots.hint("merge"), [*on, F.col(order) == F.col("__slot")], "left" if reduced else "inner").drop("__slot")
