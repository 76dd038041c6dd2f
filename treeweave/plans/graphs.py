"""Workloads over edge tables (source, target): aliases, bounded degrees, hubs, cores and strongly connected parts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import first_per_group
from ..operators.sets import unprobed
from ..sources.workspace import Workspace
from .tree import Edge, JoinTree


@dataclass(frozen=True)
class TreeShape:
    children: tuple[tuple[int, ...], ...]
    depths: tuple[int, ...]
    depth: int
    branching: int


def tree_shape(parent: Sequence[int]) -> TreeShape:
    """Of a tree whose relation 0 is the root and whose parents stand before their children."""
    if not parent or parent[0] != -1 or any(not 0 <= p < i for i, p in enumerate(parent) if i):
        raise ValueError("relation 0 is the root, and parents stand before their children")
    children = tuple(tuple(c for c, p in enumerate(parent) if p == i) for i in range(len(parent)))
    depths = [0] * len(parent)
    for c, p in enumerate(parent):
        if c:
            depths[c] = depths[p] + 1
    return TreeShape(children, tuple(depths), max(depths), max(map(len, children)))


def edge_tree(tables: Sequence[DataFrame], parent: Sequence[int]) -> JoinTree:
    """Edge tables joined child.source = parent.target."""
    tree_shape(parent)
    return JoinTree({f"R{i}": t for i, t in enumerate(tables)}, [Edge(f"R{c}", f"R{p}", ("source",), ("target",)) for c, p in enumerate(parent) if p >= 0], "R0")


def aliases(edges: DataFrame, n: int) -> list[DataFrame]:
    """The same edges under n names; each alias is a projection of its own, so that columns of self-joins stay apart."""
    return [edges.select(F.col("source").alias("source"), F.col("target").alias("target")) for _ in range(n)]


def bounded_aliases(core: DataFrame, degrees: Sequence[int]) -> list[DataFrame]:
    """For each degree the first so many targets of every source; a source with fewer than the largest degree is an error."""
    short = core.groupBy("source").agg(F.count("*").alias("n")).filter(F.col("n") < max(degrees))
    if not short.isEmpty():
        raise ValueError("a source has fewer edges than the largest degree")
    return [first_per_group(core, ["source"], ["target"], d) for d in degrees]


def hub_edges(edges: DataFrame, hubs: int, root_cap: int, middle_cap: int, leaf_cap: int) -> DataFrame:
    """Edges around the nodes with the most two-step reach: into a hub, on to its best-connected targets, and from these.

    Order of arrival is not a DataFrame property; where only some edges of a node are kept, they are those with the smallest other end.
    """
    e = edges.select("source", "target").distinct()
    out = e.groupBy(F.col("source").alias("target")).agg(F.count("*").alias("n"))
    middle = first_per_group(e.join(out, "target"), ["source"], [F.desc("n"), "target"], middle_cap)
    score = middle.groupBy("source").agg(F.sum(F.pow(F.least(F.col("n"), F.lit(leaf_cap)), 2)).cast("long").alias("score"))
    inward = e.select(F.col("target").alias("source")).distinct()
    chosen = score.join(inward, "source").orderBy(F.desc("score"), F.desc("source")).limit(hubs).select(F.col("source").alias("hub"))
    found = chosen.count()
    if found < hubs:
        raise ValueError(f"only {found} usable hubs")
    chosen = F.broadcast(chosen)  # `hubs` rows
    into = first_per_group(e.join(chosen, F.col("target") == F.col("hub")), ["target"], ["source"], root_cap).select("source", "target")
    on = middle.join(chosen, F.col("source") == F.col("hub")).select("source", "target")
    ends = on.select(F.col("target").alias("__m")).distinct()
    leaves = first_per_group(e.join(ends, F.col("source") == F.col("__m"), "left_semi"), ["source"], ["target"], leaf_cap)
    return into.unionByName(on).unionByName(leaves.select("source", "target")).distinct()


def out_core(edges: DataFrame, degree: int) -> DataFrame:
    """The largest set of nodes each of which has `degree` targets in the set, with the first so many edges of each.

    Nodes with too few edges go, round by round, until none does; every round is written.
    """
    if degree <= 0:
        raise ValueError("the degree is positive")
    work = Workspace(edges.sparkSession, "core")
    e = work.write(edges.select("source", "target").distinct(), "round0")
    n, step = e.count(), 0
    while True:
        # a semi-join on a set of nodes that grows with the graph: left to AQE, which broadcasts it if it is small
        strong = e.groupBy("source").agg(F.count("*").alias("n")).filter(F.col("n") >= degree).select(F.col("source").alias("__s"))
        kept = e.join(strong, F.col("source") == F.col("__s"), "left_semi").join(strong, F.col("target") == F.col("__s"), "left_semi")
        step += 1
        e = work.write(kept, f"round{step}")
        work.drop(f"round{step - 1}")
        left = e.count()
        if left == n:
            break
        n = left
    if not n:
        raise ValueError(f"the graph has no core of degree {degree}")
    return first_per_group(e, ["source"], ["target"], degree)


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (the largest node of it) of a directed graph.

    Colours: each node takes the largest node that reaches it; a colour's own node then walks back inside its colour, and what it
    reaches is a component. Found components leave the graph, as do nodes without edges in or out.
    """
    work = Workspace(edges.sparkSession, "strong")
    e = work.write(edges.select("source", "target").distinct(), "edges0")
    nodes = work.write(e.select(F.col("source").alias("node")).unionByName(e.select(F.col("target").alias("node"))).distinct(), "nodes0")
    done: list[DataFrame] = []
    step = 0
    while not nodes.isEmpty():
        colour = _spread(e, nodes.withColumn("value", F.col("node")), work, f"colour{step}")
        back = e.select(F.col("target").alias("source"), F.col("source").alias("target")).filter("source <> target")
        tagged = back.join(colour.select(F.col("node").alias("source"), F.col("value").alias("cs")), "source").join(colour.select(F.col("node").alias("target"), F.col("value").alias("ct")), "target").filter("cs = ct").select("source", "target")
        tagged = work.write(tagged, f"inside{step}")
        found = _reach(tagged, colour.filter("node = value").select("node"), work, f"reach{step}")
        part = work.write(colour.join(found, "node", "left_semi").select("node", F.col("value").alias("component")), f"part{step}")
        done.append(part)
        step += 1
        nodes = work.write(nodes.join(part, "node", "left_anti"), f"nodes{step}")
        keep = nodes.select(F.col("node").alias("__n"))
        e = work.write(e.join(keep, F.col("source") == F.col("__n"), "left_semi").join(keep, F.col("target") == F.col("__n"), "left_semi"), f"edges{step}")
    out = done[0] if done else nodes.withColumn("component", F.col("node"))
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _spread(e: DataFrame, values: DataFrame, work: Workspace, tag: str) -> DataFrame:
    """The largest value that reaches each node along the edges, its own included."""
    values, step = work.write(values, f"{tag}-0"), 0
    total = values.agg(F.sum(F.col("value").cast("decimal(38,0)"))).first()[0]
    while True:
        sent = e.join(values.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node")).agg(F.max("value").alias("got"))
        step += 1
        values = work.write(values.join(sent, "node", "left").select("node", F.greatest("value", F.coalesce("got", "value")).alias("value")), f"{tag}-{step}")
        now = values.agg(F.sum(F.col("value").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return values
        total = now


def _reach(e: DataFrame, start: DataFrame, work: Workspace, tag: str) -> DataFrame:
    seen, step = work.write(start, f"{tag}-0"), 0
    n = seen.count()
    while True:
        step += 1
        more = e.join(seen.withColumnRenamed("node", "source"), "source", "left_semi").select(F.col("target").alias("node"))
        seen = work.write(seen.unionByName(more).distinct(), f"{tag}-{step}")
        if (now := seen.count()) == n:
            return seen
        n = now


def sink_component_edges(edges: DataFrame, degree: int, seed: int = 0) -> DataFrame:
    """Of the core's edges, `degree` for each node by a seeded hash; then the edges inside the largest strong component that none of them leaves."""
    work = Workspace(edges.sparkSession, "sink")
    core = out_core(edges, degree)
    nodes = core.select(F.col("source").alias("__n")).distinct()
    inside = edges.select("source", "target").distinct().join(nodes, F.col("source") == F.col("__n"), "left_semi").join(nodes, F.col("target") == F.col("__n"), "left_semi")
    chosen = work.write(first_per_group(inside, ["source"], [F.xxhash64(F.lit(seed), "source", "target"), "target"], degree), "chosen")
    parts = work.write(strong_components(chosen), "parts")
    ends = chosen.join(parts.select(F.col("node").alias("source"), F.col("component").alias("cs")), "source").join(parts.select(F.col("node").alias("target"), F.col("component").alias("ct")), "target")
    left = ends.filter("cs <> ct").select(F.col("cs").alias("component")).distinct()
    sizes = parts.join(left, "component", "left_anti").groupBy("component").agg(F.count("*").alias("n"))
    best = sizes.orderBy(F.desc("n"), "component").limit(1).select(F.col("component").alias("__c"))
    return ends.join(F.broadcast(best), F.col("cs") == F.col("__c"), "left_semi").select("source", "target")  # best: one row


def equal_size_tables(edges: DataFrame, base: DataFrame, n: int) -> list[DataFrame]:
    """n edge tables of one size whose output size does not change with n: four times the base, then leaves with one edge for each
    target of the base and real edges that no target probes."""
    first = edges.groupBy("source").agg(F.min("target").alias("target"))
    base = base.join(first.select(F.col("source").alias("__s")), F.col("target") == F.col("__s"), "left_semi")
    keys = base.select(F.col("target").alias("__t")).distinct()
    leaf = first.join(keys, F.col("source") == F.col("__t"), "left_semi").select("source", "target")
    spare = unprobed(edges.select("source", "target"), "source", base, "target")
    needed = base.count() - leaf.count()
    if needed < 0 or spare.limit(needed).count() < needed:
        raise ValueError("not enough edges that no target probes")
    padding = spare.orderBy("source", "target").limit(needed)
    whole = leaf.unionByName(padding)
    return [base if i <= 3 else whole for i in range(n)]


# Parents of the nine-relation trees, by depth and by branching, and of the trees with 5, 7 and 9 relations.
DEPTH_TREES = {2: [-1, 0, 0, 0, 1, 1, 2, 2, 3], 3: [-1, 0, 0, 0, 1, 1, 2, 2, 4], 4: [-1, 0, 0, 0, 1, 1, 4, 4, 6]}
BRANCH_TREES = {2: [-1, 0, 0, 1, 1, 2, 2, 3, 3], 3: [-1, 0, 0, 0, 1, 1, 1, 4, 2], 4: [-1, 0, 0, 0, 0, 1, 1, 1, 5]}
SIZE_TREES = {5: [-1, 0, 0, 0, 1], 7: [-1, 0, 0, 0, 1, 2, 3], 9: [-1, 0, 0, 0, 1, 1, 2, 2, 3]}
# How many of the nine aliases keep three edges a source (the others two), by data scale and tree factor.
THREE_EDGE_ALIASES = {"medium": {2: 0, 3: 2, 4: 4}, "large": {2: 5, 3: 7, 4: 9}}


def suite_cases() -> dict[str, tuple[list[int], list[int]]]:
    """name: (parents, edges a source in each alias) of the 15 cases."""
    out = {}
    for scale, numbers in THREE_EDGE_ALIASES.items():
        for series, trees in (("depth_d", DEPTH_TREES), ("branch_b", BRANCH_TREES)):
            for factor, parent in trees.items():
                three = numbers[factor]
                out[f"{series}{factor}_m9_{scale}"] = (parent, [3] * three + [2] * (9 - three))
    for m, parent in SIZE_TREES.items():
        out[f"relations_m{m}_d2_b3"] = (parent, [3] * m)
    return out


# The seeds of the series' edge selections.
SERIES_SEEDS = {"depth": 0, "branch": 1, "relations": 2}


def suite_trees(edges: DataFrame, cases: Sequence[str] | None = None) -> dict[str, JoinTree]:
    """The trees of some cases, or of all. A series has one selection of edges, which is made and written once."""
    known, cores, out = suite_cases(), {}, {}
    work = Workspace(edges.sparkSession, "suite")
    for case in cases or known:
        series = case.split("_")[0]
        if series not in cores:
            cores[series] = work.write(sink_component_edges(edges, 3, SERIES_SEEDS[series]), f"core-{series}")
        parent, degrees = known[case]
        out[case] = edge_tree(bounded_aliases(cores[series], degrees), parent)
    return out
