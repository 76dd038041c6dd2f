"""Exact top-k by inner product: columnar branch-and-bound over blocks of dimensions.

Work cells are (part of the candidates, block of the queries), both bounded, and run on the executors. Candidates lie in
vertical layout, a row for each dimension. For a tile of candidates, scores grow dimension block by dimension block; what the remaining
dimensions can still add is at most the product of both vectors' remaining lengths (Cauchy-Schwarz). Pairs whose bound is under
the query's k-th score so far are gone, and the survivors are compacted before the next dimensions are read.

Scores are exact whole numbers: double precision holds them while lengths keep them under 2**53, then 64-bit integers, and Python's
integers for vectors of 2**31 or longer. A score among the k best that is outside of 64 bits is an error.

Defined cases: vectors that are null, empty, of another length than most, or hold null or non-finite components take
no part, nor do rows without an id. A repeated id is one query, with its smallest vector, and one candidate for each of
its rows, none of them a candidate of its own query. Equal scores rank by smaller id. Empty tables give no rows. Other columns are
not looked at.
"""

from __future__ import annotations

from fractions import Fraction
from math import floor
from operator import mul

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, partitions

QUERY_BLOCK = 32_768  #: queries of a work cell, about: 16 MB at 64 dimensions
CELL = 32_768  #: candidates of a work cell, about
TILE = 2048  #: candidates scored together
TASK = 2048  #: candidates that are worth a task of their own
DIM_BLOCK = 16
LONG = 2.0**31  #: products of two shorter vectors fit 64 bits

OUT = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, vec: str = "embedding") -> Column:
    """No null, NaN or infinite component, and not empty."""
    x = F.col(vec)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(True))


def common_length(vectors: DataFrame, vec: str = "embedding") -> int:
    """The length that most vectors have; of several the smallest. 0 for none."""
    got = vectors.groupBy(F.size(vec).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return got.d if got else 0


class Tops:
    """The k best (score, -id) found so far for each query of a block."""

    def __init__(self, n: int, k: int):
        import numpy as np

        self.k, self.floor = k, np.iinfo(np.int64).min + 1
        self.score = np.full((n, k), self.floor, np.int64)
        self.ids = np.full((n, k), np.iinfo(np.int64).max, np.int64)

    def limit(self):
        return self.score[:, -1]

    def add(self, q, score, ids) -> None:
        """Pairs of one tile, sorted into the lists of their queries."""
        import numpy as np

        if not len(q):
            return
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = rank < self.k
        q, score, ids, rank = q[keep], score[keep], ids[keep], rank[keep]
        rows = np.unique(q)
        new_s, new_i = np.full((len(rows), self.k), self.floor), np.full((len(rows), self.k), np.iinfo(np.int64).max)
        at = np.searchsorted(rows, q)
        new_s[at, rank], new_i[at, rank] = score, ids
        s, i = np.concatenate([self.score[rows], new_s], 1), np.concatenate([self.ids[rows], new_i], 1)
        best = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[rows], self.ids[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)


def scan(queries, query_ids, tile, ids, tops: Tops, block: int = DIM_BLOCK) -> int:
    """Scores a tile (dimensions x candidates), all of whole numbers, against all queries; returns the number of pairs that reached the last dimensions."""
    import numpy as np

    d = len(tile)
    cuts = [*range(0, d, block), d]
    # remaining lengths from each block of dimensions on, rounded up a little so that bounds stay bounds
    q_rest = [np.sqrt((queries[:, c:] ** 2).sum(1)) * (1 + 1e-9) for c in cuts]
    x_rest = [np.sqrt((tile[c:] ** 2).sum(0)) * (1 + 1e-9) for c in cuts]
    kind = np.float64 if q_rest[0].max(initial=0) * x_rest[0].max(initial=0) < 2**53 else np.int64
    q, x = queries.astype(kind, copy=False), tile.astype(kind, copy=False)
    limit = tops.limit().astype(np.float64)
    part = q[:, : cuts[1]] @ x[: cuts[1]]
    alive = part + q_rest[1][:, None] * x_rest[1][None, :] >= (limit - np.abs(limit) * 1e-9)[:, None]
    qi, xi = np.nonzero(alive & (query_ids[:, None] != ids[None, :]))
    score = part[qi, xi]
    for b in range(1, len(cuts) - 1):
        if not len(qi):
            return 0
        lo, hi = cuts[b], cuts[b + 1]
        if len(qi) * 4 > part.size:  # most are left: one product is cheaper than picking pairs
            score = score + (q[:, lo:hi] @ x[lo:hi])[qi, xi]
        else:
            add = np.empty(len(qi), kind)
            for s in range(0, len(qi), 1 << 18):
                add[s : s + (1 << 18)] = np.einsum("ij,ji->i", q[qi[s : s + (1 << 18)], lo:hi], x[lo:hi, xi[s : s + (1 << 18)]])
            score = score + add
        keep = score + q_rest[b + 1][qi] * x_rest[b + 1][xi] >= (limit - np.abs(limit) * 1e-9)[qi]
        qi, xi, score = qi[keep], xi[keep], score[keep]
    tops.add(qi, score.astype(np.int64), ids[xi])
    return len(qi)


def grid(vector, scale: int) -> list[int]:
    """floor(scale * x) of each component, whatever its size."""
    return [floor(Fraction(x) * scale) for x in vector]


def scan_long(raw_q, query_ids, raw_x, ids, scale: int, tops: Tops) -> None:
    """All pairs of vectors of which one is LONG or longer, in Python's integers."""
    import numpy as np

    exact_x = [grid(v, scale) for v in raw_x.tolist()]
    for at, (name, vector) in enumerate(zip(query_ids.tolist(), raw_q.tolist())):
        a = grid(vector, scale)
        found = sorted((-sum(map(mul, a, x)), i) for x, i in zip(exact_x, ids.tolist()) if i != name)[: tops.k]
        if any(abs(s) >= 2**63 for s, _ in found):
            raise OverflowError(f"a score of query {name} doesn't fit 64 bits")
        tops.add(np.full(len(found), at), np.array([-s for s, _ in found], np.int64), np.array([i for _, i in found], np.int64))


def _matrix(column):
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _search(k: int, scale: int):
    def search(left, right):
        import numpy as np
        import pyarrow as pa

        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            raw_x, ids = _matrix(left.column("v").combine_chunks()), left.column("vec_id").to_numpy()
            raw_q, names = _matrix(right.column("v").combine_chunks()), right.column("vec_id").to_numpy()
            with np.errstate(over="ignore"):
                x, q = np.floor(raw_x * scale), np.floor(raw_q * scale)
                long_x, long_q = ((m**2).sum(1) >= LONG**2 for m in (x, q))
            short = np.flatnonzero(~long_x)
            tile = np.ascontiguousarray(x[short].T)
            for s in range(0, len(q), 1024):
                top = Tops(len(q[s : s + 1024]), k)
                mine, brief = names[s : s + 1024], ~long_q[s : s + 1024]
                some = Tops(int(brief.sum()), k)
                for c in range(0, len(short), TILE):
                    scan(q[s : s + 1024][brief], mine[brief], tile[:, c : c + TILE], ids[short[c : c + TILE]], some)
                top.score[brief], top.ids[brief] = some.score, some.ids
                if long_x.any():
                    scan_long(raw_q[s : s + 1024], mine, raw_x[long_x], ids[long_x], scale, top)
                if not brief.all():
                    other = Tops(int((~brief).sum()), k)
                    scan_long(raw_q[s : s + 1024][~brief], mine[~brief], raw_x, ids, scale, other)
                    top.score[~brief], top.ids[~brief] = other.score, other.ids
                at, rank = np.nonzero(top.score > top.floor)
                for column, values in zip(out, (mine[at], top.ids[at, rank], top.score[at, rank])):
                    column.append(values)
        return pa.table({n: pa.array(np.concatenate(c) if c else [], pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), out)})

    return search


def exact_topk(vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", vec: str = "embedding", query_block: int = QUERY_BLOCK, cell: int = CELL) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that the condition `queries` picks, its k highest inner products of floor(scale * x)."""
    spark = vectors.sparkSession
    work = Workspace(spark, "topk")
    rows = vectors.filter(F.col(vec_id).isNotNull() & usable(vectors, vec))
    d = common_length(rows, vec)
    doubles = F.transform(F.col(vec), lambda x: x.cast("double"))
    whole = work.write(rows.filter(F.size(vec) == d).select(F.col(vec_id).cast("long").alias("vec_id"), doubles.alias("v"), queries.alias("_query")), "vectors")
    asked = work.write(whole.filter("_query").groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n, blocks = whole.count(), max(1, -(-asked.count() // query_block))
    parts = max(1, -(-n // cell), min(partitions(spark), n // TASK))
    left = whole.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = asked.select("vec_id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    out = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_search(k, scale), OUT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
