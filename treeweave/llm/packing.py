"""Best-fit packing of tokenized documents into sequences, with bounds that certify each partition's bin count.

Every partition packs its pieces by best-fit decreasing and gets a lower bound from dual feasible functions. A
partition whose count meets the bound is certified. The others give the pieces of their unfilled bins, and certified ones
those of their emptiest bin, into an exchange; the exchanged pieces are dealt anew to fewer partitions and packed again,
until the whole meets the bound of all lengths together or a round saves no bin, which is then not used. Filled bins never move again.

Defined cases: a null or empty text is the one id that ends a document; repeated rows, and null ids, are documents of
their own; an empty table gives no rows. Very long texts are cut into full pieces, the first of which takes the rest.
Only doc_id and text are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, codec, rows

CAPACITY = 2048
END = 0
BINS = 4096  #: sequences that a partition packs, about
ROWS = 500_000  #: pieces that a partition packs, about

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, before which the first takes the rest."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of each document; with keep_ids also ids, as little-endian unsigned 32-bit integers."""

    def encode(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        bpe, tail = codec(vocabulary), np.array([end], "<u2").tobytes()
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for i, text in rows(b, "doc_id", "text"):
                ids = np.frombuffer(bpe.encode(text) + tail, "<u2").astype("<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    part = ids[s : s + n].tobytes()
                    for column, x in zip(out, (i, k, s, n, zlib.crc32(part), part if keep_ids else None)):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)][: 5 + keep_ids], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, PIECES + ", ids binary" * keep_ids)


def lower_bound(counts, capacity: int) -> int:
    """Bins that lengths 1..capacity, with counts[n] pieces of length n, need at least: the best of three families of dual feasible functions."""
    import numpy as np

    x = np.arange(capacity + 1, dtype=np.int64)
    c = np.asarray(counts, dtype=np.int64)
    best = -(-int((c * x).sum()) // capacity)
    number, mass = np.concatenate([np.cumsum(c[::-1])[::-1], [0]]), np.concatenate([np.cumsum((c * x)[::-1])[::-1], [0]])
    e = np.arange(1, capacity // 2 + 1)  # pieces over capacity - e count as full, those under e as nothing
    best = max(best, int(np.max(-(-(number[capacity - e + 1] * capacity + mass[e] - mass[capacity - e + 1]) // capacity), initial=0)))
    for e in np.unique(np.linspace(1, capacity // 2, 16, dtype=np.int64)):  # pieces over half: what remains of floor(capacity / e); others: floor(x / e)
        whole = capacity // e
        f = np.where(2 * x > capacity, whole - (capacity - x) // e, x // e)
        f = np.where(2 * x == capacity, whole // 2, f)
        best = max(best, -(-int((c * np.maximum(f, 0)).sum()) // int(whole)))
    for k in range(1, 21):  # the rounding functions u(k): floor((k + 1) x) / k unless (k + 1) x is whole
        y = (k + 1) * x
        f = np.where(y % capacity == 0, x * k, (y // capacity) * capacity)
        best = max(best, -(-int((c * f).sum()) // (k * capacity)))
    return best


def best_fit(lengths, capacity: int) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of each length, which come in descending order, and what each bin holds.

    Bins are found by what they have left: bit r of `some` says that a bin has r left, so the best fit for n is the lowest bit from n on.
    """
    left: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, bins, offsets, fill = 0, [], [], []
    for n in lengths:
        above = some >> n
        if above:
            r = n + (above & -above).bit_length() - 1
            k = left[r].pop()
            if not left[r]:
                some &= ~(1 << r)
        else:
            r, k = capacity, len(fill)
            fill.append(0)
        bins.append(k)
        offsets.append(fill[k])
        fill[k] += n
        if r - n:
            left[r - n].append(k)
            some |= 1 << (r - n)
    return bins, offsets, fill


def _pack(capacity: int, level: int):
    def pack(key, t):
        import numpy as np
        import pyarrow as pa

        t = t.sort_by([("length", "descending"), ("_h", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = t.column("length").to_numpy()
        bins, offsets, fill = best_fit(lengths.tolist(), capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        filled = np.array(fill)
        open_ = filled < capacity if len(fill) > bound else np.arange(len(fill)) == int(filled.argmin())
        open_ &= filled < capacity
        names = pa.array((level << 53) + (int(key[0].as_py()) << 24) + np.array(bins, np.int64))
        extra = {"sequence_id": names, "offset": pa.array(offsets, pa.int64()), "_open": pa.array(open_[bins]), "_gap": pa.array(np.full(len(t), len(fill) - bound))}
        for name, x in extra.items():
            t = t.append_column(name, x)
        return t

    return pack


def pack(parts: DataFrame, capacity: int = CAPACITY, bins: int = BINS, most: int = ROWS) -> DataFrame:
    """parts (one row for each piece; length in 1..capacity) with sequence_id and offset."""
    spark = parts.sparkSession
    work = Workspace(spark, "pack")
    names = parts.columns
    pool = work.write(parts.withColumn("_h", F.xxhash64("doc_id", "piece", "length", F.monotonically_increasing_id())), "pieces")
    by_length = {r.length: r.n for r in pool.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    target = lower_bound([by_length.get(n, 0) for n in range(capacity + 1)], capacity)
    tokens, count, closed, made, level, before, held = sum(n * c for n, c in by_length.items()), sum(by_length.values()), [], 0, 0, None, None
    while True:  # every round but the last saves a bin
        groups = max(1, round(tokens / (capacity * bins)), -(-count // most))
        dealt = pool.withColumn("_part", F.pmod(F.xxhash64(F.lit(level), "_h"), F.lit(groups)))
        schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in dealt.schema)}, sequence_id long, offset long, _open boolean, _gap long"
        packed = work.write(dealt.groupBy("_part").applyInArrow(_pack(capacity, level), schema), f"round{level}")
        n = packed.agg(F.count_distinct("sequence_id").alias("all"), F.count_distinct(F.when(F.col("_open"), F.col("sequence_id"))).alias("open"), F.coalesce(F.sum(F.when(F.col("_open"), F.col("length"))), F.lit(0)).alias("tokens"), F.count_if("_open").alias("count")).first()
        if before is not None and n["all"] >= before:
            closed.append(held)
            break
        # every bin closed so far stays; the open ones go on only if their pieces could need fewer bins elsewhere
        if groups == 1 or made + n["all"] <= target or n.open <= -(-n.tokens // capacity):
            closed.append(packed)
            break
        closed.append(packed.filter(~F.col("_open")))
        made, tokens, count, before, held, level = made + n["all"] - n.open, n.tokens, n["count"], n.open, packed.filter("_open"), level + 1
        pool = held.select(*names, "_h")
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out.select(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    return pack(pieces(docs, capacity, end, vocabulary, keep_ids), capacity)
