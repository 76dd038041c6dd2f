"""Ways to evaluate a join tree. All give the same bag of rows.

native: one chain of joins, which Catalyst and AQE plan (the default). yannakakis: semi-joins from the leaves up first. positions: every output row gets its
number, and each relation's row for it is found by arithmetic on contributions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import FEW_SLOTS, align_copies
from ..operators.scans import global_prefix, rank_offset, suffix_product
from ..operators.shape import pad_to, with_numbers
from ..sources.workspace import Workspace
from .contributions import contributions, count_output
from .tree import JoinTree, OutputTooLarge

STRATEGIES = ("native", "yannakakis", "positions")


def _keys(e) -> tuple[list[str], list[str]]:
    return [f"{e.child}__{c}" for c in e.child_columns], [f"{e.parent}__{c}" for c in e.parent_columns]


def _chain(tree: JoinTree, relations: dict[str, DataFrame]) -> DataFrame:
    out = relations[tree.root]
    for r in tree.breadth_first()[1:]:
        child, parent = _keys(tree.edge_to(r))
        out = out.join(relations[r], [F.col(p) == F.col(c) for p, c in zip(parent, child)])
    return out


def _half_join(left: DataFrame, left_keys: list[str], right: DataFrame, right_keys: list[str], n_right: int | None = None) -> DataFrame:
    """Left rows that match. A right side that is known to have many rows is never broadcast, however small its files."""
    side = right.select(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(right_keys)])
    many = n_right is not None and n_right > FEW_SLOTS
    return left.join(side.hint("merge") if many else side, [left[a] == side[f"__s{i}"] for i, a in enumerate(left_keys)], "left_semi")


def semi_join_up(tree: JoinTree) -> dict[str, DataFrame]:
    """Each relation reduced by its subtree: only rows that have matches below. Inner relations other than the root are written, as they are read twice."""
    out = {r: tree.qualified(r) for r in tree.relations}
    work = Workspace(tree.relations[tree.root].sparkSession, "reduced")
    for r in reversed(tree.breadth_first()):
        for e in tree.children(r):
            child, parent = _keys(e)
            out[r] = _half_join(out[r], parent, out[e.child], child)
        if r != tree.root and tree.children(r):
            out[r] = work.write(out[r], f"up-{r}")
    return out


def full_reduce(tree: JoinTree) -> dict[str, DataFrame]:
    """Each relation with only the rows that are in the output."""
    out = semi_join_up(tree)
    work = Workspace(tree.relations[tree.root].sparkSession, "reduced")
    for r in tree.breadth_first():
        if r != tree.root:
            e = tree.edge_to(r)
            child, parent = _keys(e)
            out[r] = _half_join(out[r], child, out[e.parent], parent)
        if tree.children(r):
            out[r] = work.write(out[r], f"down-{r}")
    return out


def plain(df: DataFrame, relation: str) -> DataFrame:
    """Qualified columns under their own names."""
    cut = len(relation) + 2
    return df.select(*[F.col(c).alias(c[cut:]) for c in df.columns if c.startswith(f"{relation}__")])


def dangling(tree: JoinTree, relation: str) -> DataFrame:
    """Rows of a relation that are in no output row: their contribution or what lies outside is 0."""
    from .contributions import participation

    rows = participation(tree)[relation].filter(F.col(f"{relation}__participation") == 0)
    return plain(rows.drop(*[c for c in rows.columns if c.startswith(f"{relation}__u_")], f"{relation}__delta", f"{relation}__outside", f"{relation}__participation"), relation)


def _positions(tree: JoinTree) -> DataFrame:
    """The root's rows take consecutive positions, in the order of all their columns, as many as they contribute. Below it, a copy's
    number among its siblings' combinations (mixed radix, the last child fastest) names the child row that covers it."""
    work = Workspace(tree.relations[tree.root].sparkSession, "positions")
    n_rows = {r: df.count() for r, df in tree.relations.items()}
    deltas = contributions(tree, keep_dangling=False, work=work, n_rows=n_rows)
    root = tree.root
    deltas[root] = work.write(deltas[root], f"delta-{root}")
    for r in tree.breadth_first()[1:]:  # rows that the output lacks go before any is spread
        e = tree.edge_to(r)
        child, parent = _keys(e)
        deltas[r] = _half_join(deltas[r], child, deltas[e.parent], parent, n_rows[e.parent])
        if tree.children(r):
            deltas[r] = work.write(deltas[r], f"down-{r}")
    order = [c for c in deltas[root].columns if "__u_" not in c and not c.endswith("__delta")]
    state = global_prefix(deltas[root], F.col(f"{root}__delta"), order, "__b")
    state = with_numbers(state, F.lit(0), F.col(f"{root}__delta"), f"{root}__lp")
    state = state.withColumn("pos", F.col("__b") + F.col(f"{root}__lp")).drop("__b", f"{root}__delta")
    for r in tree.breadth_first():
        edges = tree.children(r)
        for e, stride in zip(edges, suffix_product([F.col(f"{r}__u_{e.child}") for e in edges])):
            child, parent = _keys(e)
            c = e.child
            rows = deltas[c]
            columns = [x for x in rows.columns if "__u_" not in x and not x.endswith("__delta")]
            leaf = not tree.children(c)
            n_slots = n_rows[c] if leaf else rows.agg(F.sum(f"{c}__delta")).first()[0] or 0
            rows = rank_offset(rows, child, None if leaf else f"{c}__delta", columns, f"{c}__h")
            state = state.withColumn("__stride", stride).withColumn("__ord", F.expr(f"(`{r}__lp` div __stride) % `{r}__u_{c}`"))
            state = align_copies(state, rows, parent, child, "__ord", f"{c}__h", f"{c}__delta", reduced=True, n_slots=n_slots)
            state = state.withColumn(f"{c}__lp", F.col("__ord") - F.col(f"{c}__h")).drop("__ord", "__stride", f"{c}__h", f"{c}__delta")
    return state


def evaluate(tree: JoinTree, strategy: str = "native", max_rows: int | None = None, column_order: str = "relation", with_position: bool = False) -> DataFrame:
    """The join's rows. With max_rows they are counted first, and a larger output is an error before it is made."""
    if max_rows is not None and (n := count_output(tree)) > max_rows:
        raise OutputTooLarge(n, max_rows)
    if strategy == "native":
        joined = _chain(tree, {r: tree.qualified(r) for r in tree.relations})
    elif strategy == "yannakakis":
        # joined from the root down, relations reduced upwards make no row that the output lacks: a sweep down would only read them once more
        joined = _chain(tree, semi_join_up(tree))
    elif strategy == "positions":
        joined = _positions(tree)
    else:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    if with_position and strategy != "positions":
        raise ValueError("only positions has a position")
    return tree.finish(joined, ["pos"] if with_position else [], column_order)


def count_up_to(tree: JoinTree, threshold: int) -> int:
    """The number of output rows, or threshold + 1 if there are more: tasks stop at so many, and no row has columns.

    For thresholds under 2**31 - 1 that are small beside the tables; the rows up to it meet in one task. count_output has no such bound.
    """
    joined = _chain(tree, {r: tree.qualified(r) for r in tree.relations})
    return joined.select(F.lit(1).alias("one")).limit(threshold + 1).count()


def materialize(tree: JoinTree, target: int, strategy: str = "native", cut: bool = False) -> DataFrame:
    """The rows padded to a target size, with __valid. A target under the exact size is an error, or with cut keeps any `target` of the rows."""
    n = count_output(tree)
    if n > target and not cut:
        raise OutputTooLarge(n, target)
    work = Workspace(tree.relations[tree.root].sparkSession, "materialized")
    rows = evaluate(tree, strategy)
    return pad_to(work.write(rows.limit(target) if n > target else rows, "rows"), target, strict=True)
