"""Approximate nearest neighbours by inner product: probed lists, scanned with an adaptive number of dimensions.

Largest inner product becomes smallest distance by one more component: sqrt(M**2 - |x|**2) for a vector, 0 for a
query. All vectors are rotated by one random orthogonal matrix, so that the first t of D dimensions hold about t / D of a
distance. Within a probed list, dimensions are read in column blocks; after t of them a candidate is abandoned once its
partial distance, scaled by D / t, is over the query's k-th distance by more than chance explains: the hypothesis test
partial > limit * t / D * (1 + eps / sqrt(t))**2. Survivors get their exact score from the original vectors.

The lists come from k-means on a bounded sample of distinct vectors (SAMPLE, or SAMPLE_PER_LIST for each list); every vector is
indexed. Their number grows with the square root of all rows, up to LISTS. A query probes its nearest lists: as many as reach
RECALL on the sample against brute force, and more until they hold k candidates.

A work cell is a group of neighbouring lists, or a part of a long one, with the queries that probe it; both sides are
bounded, so a list that holds a third of all vectors is many cells, and a query is sent once for a group of lists.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part, nor do rows without an id. A repeated id is one query, with its smallest vector, and one candidate for each of its rows, none
of them a candidate of its own query. Equal scores rank by smaller id. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, partitions, small
from .topk import common_length, usable

SAMPLE = 20_000  #: vectors that the lists are fitted on, expected, while there are few lists
SAMPLE_PER_LIST = 16
LISTS = 4096  #: most lists, so that centroids are a bounded broadcast
TRIALS = 200  #: sample vectors that serve as queries when the number of probed lists is chosen
RECALL = 0.93  #: aimed at on the sample
EPS = 2.1  #: of the hypothesis test
CELL = 4096  #: candidates of a work cell, about
QUERIES = 4096  #: queries of a work cell, about
TILE = 512  #: candidates scanned together
DIM_BLOCK = 16
DENSE = 0.1  #: while more than this share of a tile's pairs is left, a block of dimensions is one matrix product


def rotation(d: int, seed: int = 11):
    import numpy as np

    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def kmeans(x, lists: int, rounds: int = 6, seed: int = 5):
    import numpy as np

    c = x[np.random.default_rng(seed).choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c, 1)[:, 0]
        order = np.argsort(near, kind="stable")
        n = np.bincount(near, minlength=lists)
        some = np.flatnonzero(n)
        c[some] = np.add.reduceat(x[order], (np.cumsum(n) - n)[some]) / n[some, None]
    return c


def nearest(x, centroids, k: int):
    """Numbers of the k nearest centroids, nearest first."""
    import numpy as np

    out = []
    for s in range(0, len(x), 4096):
        gap = (centroids**2).sum(1)[None, :] - 2 * x[s : s + 4096] @ centroids.T
        out.append(gap.argmin(1)[:, None] if k == 1 else np.argsort(gap, axis=1, kind="stable")[:, :k])
    return np.concatenate(out) if out else np.zeros((0, k), int)


def fit(sample, lists: int, top: float, k: int) -> dict:
    """centroids, and probes, the number of lists that RECALL takes, from a sample (a matrix of original vectors) and the greatest length of all."""
    import numpy as np

    n, d = sample.shape
    turn = rotation(d + 1)
    x = lift(sample, top, turn)
    lists = int(max(1, min(lists, n // 4)))
    centroids = kmeans(x, lists)
    trials = sample[:: max(1, n // TRIALS)][:TRIALS]
    truth = np.argsort(-(trials @ sample.T), axis=1, kind="stable")[:, 1 : k + 1]  # the first is mostly the trial itself
    home = nearest(x, centroids, 1)[:, 0]
    order = nearest(lift(trials, top, turn, query=True), centroids, lists)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(lists), order.shape).copy(), 1)
    need = np.take_along_axis(place, home[truth], 1) if truth.size else np.zeros((1, 1), int)
    return {"top": top, "turn": turn, "centroids": centroids, "probes": min(int(np.quantile(need, RECALL, method="higher")) + 1, lists)}


def group_lists(centroids, sizes, cell: int = CELL):
    """(first group, number of groups) of each list: neighbouring short lists share a group of at most `cell` vectors, a long one has several of its own."""
    import numpy as np

    order: list[int] = []

    def halve(part) -> None:  # along the widest dimension, so that lists that are probed together come together
        if len(part) <= 2 or sizes[part].sum() <= cell:
            order.extend(part.tolist())
            return
        c = centroids[part]
        part = part[np.argsort(c[:, int(c.var(0).argmax())], kind="stable")]
        halve(part[: len(part) // 2])
        halve(part[len(part) // 2 :])

    halve(np.arange(len(sizes)))
    first, parts, group, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), -1, cell
    for k in order:
        n = int(sizes[k])
        if n > cell:
            first[k], parts[k] = group + 1, -(-n // cell)
            group, held = group + int(parts[k]), cell
            continue
        if held + n > cell:
            group, held = group + 1, 0
        first[k], held = group, held + n
    return first, parts


def lift(x, top: float, turn, query: bool = False):
    """Rotated vectors with the component that makes distances order as inner products do."""
    import numpy as np

    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(top**2 - (x**2).sum(1), 0))
    return np.concatenate([x, extra[:, None]], 1) @ turn


def needed(vectors, ids, k: int):
    """Rows of a cell that can be among anybody's k best: of equal vectors those with the smallest ids. A query passes over the rows of its own id, so 2 k stay, with k of an id at most."""
    import numpy as np

    _, kind = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel(), return_inverse=True)
    if len(kind) == kind.max(initial=-1) + 1:
        return np.arange(len(ids))

    def rank(*columns):
        new = np.zeros(len(columns[0]), bool)
        for c in columns:
            new |= np.concatenate(([True], c[1:] != c[:-1]))
        return np.arange(len(new)) - np.flatnonzero(new)[np.cumsum(new) - 1]

    order = np.lexsort((ids, kind))
    order = order[rank(kind[order], ids[order]) < k]
    return np.sort(order[rank(kind[order]) < 2 * k])


def scan_cell(queries, query_ids, rotated_q, probed, vectors, ids, rotated_x, lists, k: int, eps: float = EPS):
    """(query position, id, score) of the k best of a cell for each query; probed: (queries x lists of the cell), whether a query probes a list.

    Columns of the rotated vectors are read in blocks: while many pairs are left as matrix products, then pair by pair.
    """
    import numpy as np

    big = np.iinfo(np.int64).max
    n, dims = len(queries), rotated_q.shape[1]
    best, names = np.full((n, k), -np.inf), np.full((n, k), big, np.int64)
    qq, far = (queries**2).sum(1), (rotated_x**2).sum(1).max(initial=0.0)  # all lifted vectors are equally long
    gap = np.full(n, np.inf)  # squared distance of the k-th best so far
    columns = np.ascontiguousarray(rotated_x.T)
    slack = 1e-9 * (1 + far + qq)

    def limit(rows, hi: int):
        return gap[rows] * hi / dims * (1 + (eps / hi**0.5 if hi < dims else 0.0)) ** 2 + slack[rows]

    for s in range(0, len(ids), TILE):
        x, i, cols = vectors[s : s + TILE], ids[s : s + TILE], columns[:, s : s + TILE]
        asks = probed[:, lists[s : s + TILE]] & (query_ids[:, None] != i[None, :])
        rows = np.flatnonzero(asks.any(1))
        if not len(rows):
            continue
        q, alive = rotated_q[rows], asks[rows]
        part, lo, dense = np.zeros(alive.shape), 0, True
        while dense and lo < dims:
            hi = min(lo + DIM_BLOCK, dims)
            a, b = q[:, lo:hi], cols[lo:hi]
            part += (a**2).sum(1)[:, None] + (b**2).sum(0)[None, :]
            part -= 2 * a @ b
            alive &= part <= limit(rows, hi)[:, None]
            lo, dense = hi, np.count_nonzero(alive) > DENSE * alive.size
        if lo == dims:
            full = np.flatnonzero(alive.sum(1) > 2 * k)  # mostly those that had no limit yet
            if len(full):
                kth = np.partition(np.where(alive[full], part[full], np.inf), k - 1, axis=1)[:, k - 1]
                alive[full] &= part[full] <= (kth + slack[rows[full]])[:, None]
        at, xi = np.nonzero(alive)
        part = part[at, xi]
        while len(at) and lo < dims:
            hi = min(lo + DIM_BLOCK, dims)
            for p in range(0, len(at), 1 << 16):
                r = slice(p, p + (1 << 16))
                part[r] += ((q[at[r], lo:hi] - cols[lo:hi, xi[r]].T) ** 2).sum(1)
            keep = part <= limit(rows[at], hi)
            at, xi, part, lo = at[keep], xi[keep], part[keep], hi
        if not len(at):
            continue
        qi, score = rows[at], np.empty(len(at))
        for p in range(0, len(qi), 1 << 16):
            r = slice(p, p + (1 << 16))
            score[r] = (queries[qi[r]] * x[xi[r]]).sum(1)
        keep = score >= best[qi, -1]
        qi, xi, score = qi[keep], xi[keep], score[keep]
        if not len(qi):
            continue
        order = np.lexsort((i[xi], -score, qi))
        qi, xi, score = qi[order], xi[order], score[order]
        first = np.flatnonzero(np.concatenate(([True], qi[1:] != qi[:-1])))
        rank = np.arange(len(qi)) - np.repeat(first, np.diff(np.append(first, len(qi))))
        keep = rank < k
        qi, xi, score, rank = qi[keep], xi[keep], score[keep], rank[keep]
        some = np.unique(qi)
        at = np.searchsorted(some, qi)
        new_s, new_i = np.full((len(some), k), -np.inf), np.full((len(some), k), big, np.int64)
        new_s[at, rank], new_i[at, rank] = score, i[xi]
        all_s, all_i = np.concatenate([best[some], new_s], 1), np.concatenate([names[some], new_i], 1)
        pick = np.lexsort((all_i, -all_s), axis=1)[:, :k]
        best[some], names[some] = np.take_along_axis(all_s, pick, 1), np.take_along_axis(all_i, pick, 1)
        gap[some] = np.where(np.isfinite(best[some, -1]), qq[some] + far - 2 * best[some, -1], np.inf)
    at, rank = np.nonzero(np.isfinite(best))
    return at, names[at, rank], best[at, rank]


def _matrix(column):
    import numpy as np

    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _index(model):
    """Adds the nearest list."""

    def index(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = model.value
        for b in batches:
            if b.num_rows:
                near = nearest(lift(_matrix(b.column("v")), m["top"], m["turn"]), m["centroids"], 1)[:, 0]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(near.astype("int32"))], names=["vec_id", "v", "list"])

    return index


def _route(model, first, parts, sizes, k: int):
    """A row for each group that a query meets, with the lists it probes there."""

    def route(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        m = model.value
        for b in batches:
            for s in range(0, b.num_rows, 256):
                some = b.slice(s, 256)
                order = nearest(lift(_matrix(some.column("v")), m["top"], m["turn"], query=True), m["centroids"], len(m["centroids"]))
                # more lists until they hold k rows besides the query's own
                short = np.cumsum(sizes[order], axis=1) < k + some.column("n").to_numpy()[:, None]
                probes = np.maximum(m["probes"], short.sum(1) + 1)
                row, place = np.nonzero(np.arange(order.shape[1])[None, :] < probes[:, None])
                lists = order[row, place]
                row, lists = row[sizes[lists] > 0], lists[sizes[lists] > 0]
                copies = parts[lists]
                ends = np.cumsum(copies)
                group = np.repeat(first[lists] - (ends - copies), copies) + np.arange(ends[-1] if len(ends) else 0)
                row, lists = np.repeat(row, copies), np.repeat(lists, copies)
                by = np.lexsort((lists, group, row))
                row, group, lists = row[by], group[by], lists[by]
                new = np.flatnonzero(np.concatenate((np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (group[1:] != group[:-1]))))
                at, offsets = row[new], pa.array(np.append(new, len(row)), pa.int32())
                for p in range(0, len(at), 4096):
                    t = slice(p, p + 4096)
                    take = pa.array(at[t])
                    held = pa.ListArray.from_arrays(offsets[p : p + len(take) + 1], pa.array(lists, pa.int32()))
                    yield pa.RecordBatch.from_arrays([some.column("vec_id").take(take), some.column("v").take(take), pa.array(group[new[t]]), held], names=["vec_id", "v", "group", "lists"])

    return route


def _scan(model, k: int):
    def scan(left, right):
        import numpy as np
        import pyarrow as pa

        m = model.value
        x, q = _matrix(left.column("v").combine_chunks()), _matrix(right.column("v").combine_chunks())
        if not len(x) or not len(q):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, names, lists = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy(), left.column("list").to_numpy()
        rows = needed(x, ids, k)
        rows = rows[np.argsort(lists[rows], kind="stable")]
        here, at = np.unique(lists[rows], return_inverse=True)
        asked = right.column("lists").combine_chunks()
        probed = np.zeros((len(names), len(m["centroids"])), bool)
        probed[np.repeat(np.arange(len(names)), asked.value_lengths().to_numpy()), asked.flatten().to_numpy()] = True
        found, got, score = scan_cell(q, names, lift(q, m["top"], m["turn"], query=True), probed[:, here], x[rows], ids[rows], lift(x[rows], m["top"], m["turn"]), at, k)
        return pa.table({"query_id": pa.array(names[found]), "vec_id": pa.array(got), "score": pa.array(score)})

    return scan


def search(vectors: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that `queries`, a condition on the id, picks, its k nearest found."""
    import numpy as np

    spark = vectors.sparkSession
    work = Workspace(spark, "ann")
    rows = vectors.filter(F.col(vec_id).isNotNull() & usable(vectors, vec)).filter(F.exists(F.col(vec), lambda v: v != 0))
    d = common_length(rows, vec)
    rows = rows.filter(F.size(vec) == d).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(F.col(vec), lambda v: v.cast("double")).alias("v"), queries.alias("_query")).withColumn("_h", F.xxhash64("v"))
    facts = rows.agg(F.count("*").alias("n"), F.approx_count_distinct("_h").alias("kinds"), F.max(F.aggregate("v", F.lit(0.0), lambda a, v: a + v * v)).alias("most")).first()
    if not facts.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = min(LISTS, round(2 * facts.n**0.5))
    wanted = max(SAMPLE, SAMPLE_PER_LIST * lists)
    near = rows.filter(F.pmod("_h", F.lit(1_000_000)) < F.lit(max(1, round(1_000_000 * min(1.0, wanted / facts.kinds))))).groupBy("_h").agg(F.min("v").alias("v"))
    got = near.orderBy("_h").limit(2 * wanted).select("v").toArrow()  # twice what is expected bounds the driver's memory; only the fit is on it
    sample = _matrix(got.column("v").combine_chunks()) if got.num_rows else np.ones((1, d))
    model = spark.sparkContext.broadcast(fit(sample, lists, float(facts.most) ** 0.5 * 1.0001, k))
    index = work.write(rows.select("vec_id", "v").mapInArrow(_index(model), "vec_id long, v array<double>, list int"), "index")
    sizes = np.zeros(len(model.value["centroids"]), np.int64)
    for r in index.groupBy("list").agg(F.count("*").alias("n")).collect():  # at most LISTS rows
        sizes[r.list] = r.n
    first, parts = group_lists(model.value["centroids"], sizes)
    asked = rows.filter("_query").groupBy("vec_id").agg(F.min("v").alias("v"), F.count("*").alias("n")).repartition(partitions(spark), "vec_id")
    routed = work.write(asked.mapInArrow(_route(model, first, parts, sizes, k), "vec_id long, v array<double>, group long, lists array<int>"), "routed")
    blocks = routed.groupBy("group").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    blocks = small(blocks, int((first + parts).max()))
    place = F.element_at(F.lit(first.tolist()), F.col("list") + 1) + F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.element_at(F.lit(parts.tolist()), F.col("list") + 1))
    left = index.withColumn("group", place).join(blocks, "group").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("group", "block", "vec_id", "v", "list")
    right = routed.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).select("group", "block", "vec_id", "v", "lists")
    found = left.groupBy("group", "block").cogroup(right.groupBy("group", "block")).applyInArrow(_scan(model, k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
