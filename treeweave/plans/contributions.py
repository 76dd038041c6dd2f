"""How many output rows each row takes part in, counted along the tree without making the output."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import ArithmeticException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import FEW_SLOTS
from ..sources.workspace import Workspace
from .tree import CountOverflow, Edge, JoinTree

LONG_MAX = 2**63 - 1


def _saturated(c: Column) -> Column:
    """At most LONG_MAX; null, the sum of no rows, stays null, which least() would pass over."""
    wide, top = c.cast("decimal(38,0)"), F.lit(LONG_MAX).cast("decimal(38,0)")
    return F.when(wide > top, top).otherwise(wide).cast("long")


def _times(a: Column, b: Column, saturate: bool) -> Column:
    return _saturated(a.cast("decimal(19,0)") * b.cast("decimal(19,0)")) if saturate else a * b


def _total(c: str, saturate: bool) -> Column:
    return _saturated(F.sum(F.col(c).cast("decimal(19,0)"))) if saturate else F.sum(c)


def _totals(df: DataFrame, columns: list[str], value: str, name: str, saturate: bool) -> DataFrame:
    keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(columns)]
    return df.select(*keys, value).groupBy(*[f"__k{i}" for i in range(len(columns))]).agg(_total(value, saturate).alias(name))


def _on(df: DataFrame, columns: list[str], sums: DataFrame) -> list[Column]:
    return [df[c] == sums[f"__k{i}"] for i, c in enumerate(columns)]


def _child(e: Edge) -> list[str]:
    return [f"{e.child}__{c}" for c in e.child_columns]


def _parent(e: Edge) -> list[str]:
    return [f"{e.parent}__{c}" for c in e.parent_columns]


def contributions(tree: JoinTree, saturate: bool = False, keep_dangling: bool = True, work: Workspace | None = None, n_rows: Mapping[str, int] | None = None) -> dict[str, DataFrame]:
    """For each relation its qualified rows with u_<child> (the summed delta of its matches) and delta, their product; leaves have 1.

    keep_dangling=False leaves out rows of delta 0, and so joins inside only. With work, inner relations other than the root are
    written: who reads them besides their parent's sums doesn't count their subtrees again. n_rows: rows of each relation; Spark sizes files as they are
    compressed, so where both sides of a join may have many rows neither is broadcast.
    """
    out: dict[str, DataFrame] = {}
    for r in reversed(tree.breadth_first()):
        df = tree.qualified(r)
        delta = F.lit(1).cast("long")
        for e in tree.children(r):
            u = f"{r}__u_{e.child}"
            sums = _totals(out[e.child], _child(e), f"{e.child}__delta", u, saturate)
            keys = [f"__k{i}" for i in range(len(e.child_columns))]
            many = n_rows is not None and min(n_rows[r], n_rows[e.child]) > FEW_SLOTS
            df = df.join(sums.hint("merge") if many else sums, _on(df, _parent(e), sums), "left" if keep_dangling else "inner").drop(*keys)
            if keep_dangling:
                df = df.withColumn(u, F.coalesce(u, F.lit(0)))
            delta = _times(delta, F.col(u), saturate)
        df = df.withColumn(f"{r}__delta", delta)
        out[r] = work.write(df, f"delta-{r}") if work and r != tree.root and tree.children(r) else df
    return out


def root_contributions(tree: JoinTree, saturate: bool = False) -> DataFrame:
    return contributions(tree, saturate)[tree.root]


def output_size(tree: JoinTree, saturate: bool = False) -> DataFrame:
    """One row: output_rows, exact, from one pass over each relation."""
    root = contributions(tree, saturate, keep_dangling=False)[tree.root]
    return root.agg(F.coalesce(_total(f"{tree.root}__delta", saturate), F.lit(0)).alias("output_rows"))


def count_output(tree: JoinTree, saturate: bool = False) -> int:
    try:
        return output_size(tree, saturate).first().output_rows
    except ArithmeticException as e:
        raise CountOverflow("the number of output rows does not fit into 64 bits") from e


def participation(tree: JoinTree, saturate: bool = False) -> dict[str, DataFrame]:
    """For each relation its rows with outside (output rows for one subtree match) and participation = outside * delta, the output rows each is in.

    Bottom-up deltas meet a top-down pass: a child's outside is the sum, over the parent rows it matches, of their outside times
    the other children's u. Either pass reads each base table once: what a later step reads again is written.
    """
    work = Workspace(tree.relations[tree.root].sparkSession, "participation")
    deltas = contributions(tree, saturate, work=work)
    if tree.children(tree.root):
        deltas[tree.root] = work.write(deltas[tree.root], f"delta-{tree.root}")
    out = {tree.root: deltas[tree.root].withColumn(f"{tree.root}__outside", F.lit(1).cast("long"))}
    for r in tree.breadth_first():
        for e in tree.children(r):
            factor = F.col(f"{r}__outside")
            for other in tree.children(r):
                if other.child != e.child:
                    factor = _times(factor, F.col(f"{r}__u_{other.child}"), saturate)
            name = f"{e.child}__outside"
            sums = _totals(out[r].withColumn("__f", factor), _parent(e), "__f", name, saturate)
            df = deltas[e.child]
            keys = [f"__k{i}" for i in range(len(e.child_columns))]
            df = df.join(sums, _on(df, _child(e), sums), "left").drop(*keys).withColumn(name, F.coalesce(name, F.lit(0)))
            out[e.child] = work.write(df, f"outside-{e.child}") if tree.children(e.child) else df
    return {r: df.withColumn(f"{r}__participation", _times(F.col(f"{r}__outside"), F.col(f"{r}__delta"), saturate)) for r, df in out.items()}


def max_participation(tree: JoinTree, saturate: bool = True) -> DataFrame:
    """relation, max_participation: the most output rows that one row of each relation is in."""
    parts = [df.agg(F.lit(r).alias("relation"), F.coalesce(F.max(f"{r}__participation"), F.lit(0)).alias("max_participation")) for r, df in participation(tree, saturate).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
