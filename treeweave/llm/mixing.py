"""Mixing sources to target weights by cube-method balanced sampling.

A source's target may be up to `most` times its size, so every document is taken floor(target / size) whole times and
once more with the fractional rest as its inclusion probability. The cube method settles these probabilities: its
flight phase moves them along the null space of the constraints (the number of documents and the number of tokens),
three documents at a time, until at most two of a group are undecided. Groups are bounded chunks of a source; what
they leave undecided meets in further rounds. The landing of the last few documents, which a source keeps from all sizes,
tries all their subsets and takes the one nearest to what is expected: these LANDING documents of a source are settled by that, not at random.

Defined cases: null or empty texts have size 0 and take 0 words; a null source is a source, last in the order; a
source of size 0 has target 0; repeated rows are documents of their own; an empty table gives no rows. The random
choices come from hashes of source, chunk and seed, and rows that agree in doc_id, source and text are numbered among themselves: reruns
agree, however the files are split. Other columns are not looked at.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, n_words, partitions, small

LANDING = 13  #: documents of all sizes that a source keeps for the landing, besides what the flight leaves
CHUNK = 20_000  #: documents that one task settles at a time
COPIES = 65_536  #: repeated rows that one task writes out at a time
EPS = 1e-9


def flight(sizes, p, seed: int):
    """Moves the probabilities p in place until no null-space direction is left: at most 2 stay fractional.

    The sum of p and the sum of sizes * p stay the same up to rounding. Three documents have a direction for two constraints;
    two of equal size have one, too.
    """
    import random

    draw = random.Random(seed).random
    held: list[int] = []
    for k in range(len(p)):
        if EPS < p[k] < 1 - EPS:
            held.append(k)
        while len(held) == 3 or (len(held) == 2 and sizes[held[0]] == sizes[held[1]]):
            s = [sizes[i] for i in held]
            if len(held) == 2:
                u = [1.0, -1.0]
            elif s[0] == s[1] or s[1] == s[2] or s[0] == s[2]:
                a, b = (0, 1) if s[0] == s[1] else (1, 2) if s[1] == s[2] else (0, 2)
                u = [0.0, 0.0, 0.0]
                u[a], u[b] = 1.0, -1.0
            else:
                m = max(abs(s[1] - s[2]), abs(s[2] - s[0]), abs(s[0] - s[1]))
                u = [(s[1] - s[2]) / m, (s[2] - s[0]) / m, (s[0] - s[1]) / m]
            up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(held, u) if x)
            down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(held, u) if x)
            move = up if draw() * (up + down) < down else -down
            for i, x in zip(held, u):
                p[i] += move * x
                if p[i] < EPS or p[i] > 1 - EPS:
                    p[i] = round(p[i])
            held = [i for i in held if 0 < p[i] < 1]
    return held


def landing(sizes, p, left: list[int]) -> None:
    """Settles the documents left: the subset whose tokens, and then number, come nearest to what is expected."""
    import numpy as np

    size, share = np.array([sizes[i] for i in left], float), np.array([p[i] for i in left])
    masks = (np.arange(2 ** len(left))[:, None] >> np.arange(len(left))) & 1
    off = np.abs(masks @ size - size @ share) + 0.25 * np.abs(masks.sum(1) - share.sum())
    for i, x in zip(left, masks[int(off.argmin())]):
        p[i] = float(x)


def _order(seed: int):
    return F.xxhash64(F.lit(seed), "doc_id", "source", "text")


def _settle(last: bool, seed: int):
    def settle(key, t):
        import zlib

        import pyarrow as pa

        t = t.sort_by([("size", "descending"), ("_order", "ascending"), ("_row", "ascending")])
        sizes, p = t.column("size").to_pylist(), t.column("_p").to_pylist()
        held = sorted({round(k * (len(p) - 1) / (LANDING - 1)) for k in range(LANDING)}) if last else []
        kept = {i: p[i] for i in held}
        for i in held:
            p[i] = 0.0  # these wait for the landing
        left = flight(sizes, p, zlib.crc32(repr((seed, [k.as_py() for k in key])).encode()))
        for i in held:
            p[i] = kept[i]
        if last:
            landing(sizes, p, left + held)
        return t.set_column(t.column_names.index("_p"), "_p", pa.array(p, pa.float64()))

    return settle


def numbered(rows: DataFrame) -> DataFrame:
    """rows with _row, 0, 1, ... among equal ones. Equal rows are counted on both sides of the shuffle and made again from their number, so a row that
    repeats without end is no single task's."""
    names = rows.columns
    kinds = rows.groupBy(*names).agg(F.count("*").alias("_k"))
    long = F.lit(0).cast("long")
    few = kinds.filter(F.col("_k") <= COPIES).select(*names, F.explode(F.sequence(long, F.col("_k") - 1)).alias("_row"))
    many = kinds.filter(F.col("_k") > COPIES).withColumn("_block", F.explode(F.sequence(long, F.floor((F.col("_k") - 1) / COPIES))))
    many = many.repartition(partitions(rows.sparkSession), "_order", "_block")
    inside = F.sequence(F.col("_block") * COPIES, F.least((F.col("_block") + 1) * COPIES, F.col("_k")) - 1)
    return few.unionByName(many.select(*names, F.explode(inside).alias("_row")))


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """_source, source_size, n, target. Targets follow the weights and stop at most * source_size; the excess is dealt out again by weight.

    Water filling in closed form: in the order of most * size / weight, the first sources are at their limit, and the
    rest share what these leave. The windows run over one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("_w", w).withColumn("_cap", F.lit(float(most)) * F.col("source_size")).withColumn("_at", F.col("_cap") / F.col("_w"))
    by = Window.orderBy("_at", F.col("source").asc_nulls_last())
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_level", (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    per = per.withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_at"), F.col("_level"))).over(whole))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level"), F.max("_at").over(whole)) * F.col("_w"))
    return per.select(F.col("source").alias("_source"), "source_size", "n", target.alias("target"))


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, seed: int = 7, chunk: int = CHUNK) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken for each row, with _order, a hash of its content, and _row, its number among equal rows."""
    spark = docs.sparkSession
    work = Workspace(spark, "mix")
    sizes = work.write(numbered(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _order(seed).alias("_order"))), "sizes")
    targets = work.write(source_targets(sizes, weights, share, most).coalesce(1), "targets")
    n_sources, most_rows = targets.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sizes.join(small(targets, n_sources), sizes["source"].eqNullSafe(targets["_source"])).drop("_source")
    rows = rows.withColumn("_rate", rate)
    rows = rows.withColumn("_whole", F.floor(F.col("_rate") + EPS)).withColumn("_p", F.greatest(F.col("_rate") - F.col("_whole"), F.lit(0.0)))
    settled, rows = rows.filter((F.col("size") == 0) | (F.col("_p") <= EPS)), rows.filter((F.col("size") > 0) & (F.col("_p") > EPS))
    settled = settled.withColumn("_p", F.lit(0.0))
    level = 0
    while True:
        last = most_rows <= chunk
        chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(chunk)))
        group = F.pmod(F.xxhash64(F.lit(level), "_order", "_row"), F.lit(1) if last else chunks)
        schema = rows.schema
        keyed = rows.withColumn("_chunk", group)
        done = keyed.groupBy("source", "_chunk").applyInArrow(_settle(last, seed + level), keyed.schema).drop("_chunk")
        if last:
            break
        done = work.write(done.select(*schema.names), f"level{level}")
        fractional = (F.col("_p") > 0) & (F.col("_p") < 1)
        settled, rows = settled.unionByName(done.filter(~fractional)), done.filter(fractional)
        per = rows.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("n"))
        most_rows = per.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        rows = rows.drop("n").join(small(per, n_sources), rows["source"].eqNullSafe(per["_source"])).select(*schema.names)
        level += 1
    out = settled.unionByName(done).withColumn("times", (F.col("_whole") + F.col("_p").cast("long")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"), "_order", "_row")


def mixed_documents(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """docs' rows as often as the mix takes them.

    Rows that agree in doc_id, source and text are the same to the mix; such repeated rows are merged before their
    copies are made, with the merging done on each side of the shuffle. All columns are kept, whatever their names.
    """
    taken = mix(docs, weights, share, most, seed).groupBy("doc_id", "_order").agg(F.sum("times").alias("times"), F.count("*").alias("n")).filter("times > 0")
    rows = docs.select("doc_id", _order(seed).alias("_order"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).alias("r")
    rows = rows.join(taken.alias("t"), (F.col("r._order") == F.col("t._order")) & F.col("r.doc_id").eqNullSafe(F.col("t.doc_id"))).select("r.*", "times", "n")
    once = rows.filter("n = 1").unionByName(rows.filter("n > 1").dropDuplicates(["doc_id", "_order"]))
    return once.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("row.*")
