"""Connected components of a table of edges, by alternating large-star and small-star steps. Nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(edges: DataFrame, work: Workspace, tag: str = "components") -> DataFrame:
    """node, component (the smallest node it is linked with) for every node of edges (a, b: long) but the smallest of each component.

    A step links the larger neighbours of each node to its smallest neighbour, then the smaller ones; both keep what is connected, and
    the edges end as stars. Every step is written, and the last two are compared by count and hash sum. Null ends and loops are left out.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    facts, step = None, 0
    while True:
        e = work.write(e, f"{tag}{step}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if step:
            work.drop(f"{tag}{step - 1}")
        if now == facts or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        facts, step = now, step + 1
