"""N-gram Jaccard self-join with adaptive multi-match prefixes, and the components of its links.

Two documents link when the Jaccard similarity of their word-shingle sets is at least 80 / 100. In any fixed order of
shingles, the first n - ceil(0.8 n) + l shingles of both sets, their l-prefixes, then share at least l. Which l a document
uses is its own choice: a pair has to share the smaller of its two l.

1. Screen, order by hash. Every document publishes the prefix for l = ceil(0.8 n) / 10; those with too few prefix
   shingles that occur elsewhere can't link. Tasks first count within their own documents, so a shingle that a third of all documents hold is sent once a task.
2. The sets of the rest are written; equal sets become one representative.
3. Order by frequency among representatives, rarest first. Each lengthens its prefix to the l of least estimated cost:
   entries to read, plus candidates to verify, of which there are at most entries / l.
4. Every prefix shingle has a hub, the most typical document that holds it in its prefix. Documents are verified against
   their hubs: one pair each instead of all pairs of a group. Links give first components.
5. Pairs of different components that share enough prefix shingles, and whose overlap can be large enough given their
   sizes, unshared shingles and overlaps with their hub, are verified. Documents in a hub's component are not compared with
   one another; long lists are dealt over bounded cells.

Defined cases: null or empty texts have 0 shingles and link with nothing; a text of fewer words than a shingle is one
shingle; doc_id names a document: rows that repeat it are one document, with the links of all their texts and the size of the largest set;
rows without an id get component null and 0 shingles. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dense_ids
from .common import Workspace, partitions, release, small
from .components import components

SHARE = 10  #: the screen's l is ceil(0.8 n) / SHARE
FLUSH = 400_000  #: prefix shingles that a task of the screen holds
BATCH = 400_000  #: shingles of a written batch of representatives
MOST = 64  #: longest l
VERIFY = 20.0  #: cost of a verification against that of reading a prefix entry
CELL = 1000  #: documents of a side of a cell, about
ENTRIES = 8000  #: prefix entries of a side of a cell, about


def need(n):
    """Least overlap of a set of n with any set that it links with: ceil(0.8 n)."""
    return -(-4 * n // 5)


def _split(h, buckets: int):
    """Order by bucket, and where each bucket starts and ends."""
    import numpy as np

    b = ((h >> np.uint64(7)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    at = np.searchsorted(b[order], np.arange(buckets + 1))
    return order, at


def _publish(buckets: int, words: int):
    """Blobs for the screen: prefix shingles with their document (or marked as held by several here), and each document's facts."""

    def publish(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .shingles import shingle_sets

        names = ["bucket", "facts", "h", "d", "m"]
        kinds = [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
        held, sizes, docs, n = [], [], [], 0

        def flush() -> pa.RecordBatch:
            ids, size = np.array(docs, np.int64), np.array(sizes, np.int64)
            h = np.concatenate(held) if held else np.zeros(0, np.uint64)
            own = np.repeat(np.arange(len(held)), [len(x) for x in held])
            order = np.argsort(h, kind="stable")
            h, own = h[order], own[order]
            first = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
            starts = np.flatnonzero(first)
            count = np.diff(np.append(starts, len(h)))
            several = np.repeat(count > 1, count)
            matched = np.bincount(own[several], minlength=len(ids))
            h, d, m = h[starts], ids[own[starts]] if len(starts) else np.zeros(0, np.int64), (count > 1).astype(np.uint8)
            order, at = _split(h, buckets)
            h, d, m = h[order], d[order], m[order]
            some = [b for b in range(buckets) if at[b + 1] > at[b]]
            rows = [(b, False, h[at[b] : at[b + 1]].tobytes(), d[at[b] : at[b + 1]].tobytes(), m[at[b] : at[b + 1]].tobytes()) for b in some]
            # facts go to any bucket; they only pass through
            rows.append((int(ids[0] % buckets) if len(ids) else 0, True, size.tobytes(), ids.tobytes(), matched.astype(np.int64).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for b in batches:
            for i, s in zip(b.column("doc_id").to_pylist(), shingle_sets(b.column("text"), words)):
                c = need(len(s))
                if len(s):
                    held.append(s[: min(len(s), len(s) - c + max(1, c // SHARE))].copy())  # not a view, which would keep the whole set
                    docs.append(i)
                    sizes.append(len(s))
                    n += len(held[-1])
                if n >= FLUSH:
                    yield flush()
                    held, sizes, docs, n = [], [], [], 0
        if docs:
            yield flush()
        release()

    return publish


def _summed(ids, sizes, matched):
    """Arrays of ids with their largest size and summed matches."""
    import numpy as np

    u, at = np.unique(ids, return_inverse=True)
    n, m = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
    np.maximum.at(n, at, sizes)
    np.add.at(m, at, matched)
    return u, n, m


def _screen(parts: int):
    def screen(t):
        """Documents' facts, and how many of their prefix shingles occur in another task's documents too; one row for each part of the documents."""
        import numpy as np
        import pyarrow as pa

        facts = np.array(t.column("facts").to_pylist(), bool)
        hs, ds, ms = (t.column(c).to_pylist() for c in "hdm")
        ids, sizes, matched = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in np.flatnonzero(facts):
            for out, blob in ((ids, ds[k]), (sizes, hs[k]), (matched, ms[k])):
                out.append(np.frombuffer(blob, np.int64))
        rest = np.flatnonzero(~facts)
        if len(rest):
            h = np.concatenate([np.frombuffer(hs[k], np.uint64) for k in rest])
            d = np.concatenate([np.frombuffer(ds[k], np.int64) for k in rest])
            m = np.concatenate([np.frombuffer(ms[k], np.uint8) for k in rest])
            order = np.argsort(h, kind="stable")
            h, d, m = h[order], d[order], m[order]
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            count = np.diff(np.append(starts, len(h)))
            hit = d[np.repeat(count > 1, count) & (m == 0)]  # those held by several in one task are counted there
            ids.append(hit)
            sizes.append(np.zeros(len(hit), np.int64))
            matched.append(np.ones(len(hit), np.int64))
        u, n, m = _summed(np.concatenate(ids), np.concatenate(sizes), np.concatenate(matched))
        order, at = _split(u.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts)
        some = [p for p in range(parts) if at[p + 1] > at[p]]
        blobs = [pa.array([x[order[at[p] : at[p + 1]]].tobytes() for p in some], pa.binary()) for x in (u, n, m)]
        return pa.table({"part": pa.array(some, pa.int32()), "d": blobs[0], "n": blobs[1], "m": blobs[2]})

    return screen


def _gather(t):
    """doc_id, n, matched of one part of the documents."""
    import numpy as np
    import pyarrow as pa

    u, n, m = _summed(*(np.concatenate([np.frombuffer(x, np.int64) for x in t.column(c).to_pylist()]) for c in "dnm"))
    return pa.table({"doc_id": u, "n": n, "matched": m})


def _sets(words: int):
    def sets(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .shingles import mix, one_shingle_names, shingle_sets

        for b in batches:
            got = list(shingle_sets(b.column("text"), words))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in got])])
            h = np.concatenate(got) if got else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h.view(np.int64)))
            # a set's 128-bit name: sums of two hashes of its shingles; of a single shingle one of its words
            one, two = (np.array([mix(s, f).sum() for s in got], np.uint64).view(np.int64) for f in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))
            single = np.flatnonzero(np.diff(ends) == 1)
            if len(single):
                names = np.frombuffer(b"".join(one_shingle_names(b.column("text").take(pa.array(single)), words)), np.int64).reshape(-1, 2)
                one[single], two[single] = names[:, 0], names[:, 1]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array(one), pa.array(two), lists], names=["doc_id", "n", "c1", "c2", "s"])
        release()

    return sets


def _batches(batches: Iterator) -> Iterator:
    """Rows of about BATCH shingles: the documents' ids, sizes and sets."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part, k, n, ids, sets = TaskContext.get().partitionId(), 0, 0, [], []

    def row() -> pa.RecordBatch:
        values = [(part << 32) + k, np.array(ids, np.int64).tobytes(), np.array([len(s) for s in sets], np.int64).tobytes(), np.concatenate(sets).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["batch", "d", "n", "h"])

    for b in batches:
        column = b.column("s")
        flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
        ends = ends - ends[0]
        for i, s, e in zip(b.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
            ids.append(i)
            sets.append(flat[s:e].view(np.uint64))
            n += e - s
            if n >= BATCH:
                yield row()
                k, n, ids, sets = k + 1, 0, [], []
    if ids:
        yield row()
    release()


def _count(buckets: int):
    """Each batch's shingles and how many of its documents hold them, by bucket."""

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for batch, blob in zip(b.column("batch").to_pylist(), b.column("h").to_pylist()):
                h = np.sort(np.frombuffer(blob, np.uint64))
                starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                c, h = np.diff(np.append(starts, len(h))).astype(np.uint32), h[starts]
                order, at = _split(h, buckets)
                h, c = h[order], c[order]
                some = [k for k in range(buckets) if at[k + 1] > at[k]]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([batch] * len(some), pa.int64()), pa.array([h[at[k] : at[k + 1]].tobytes() for k in some], pa.binary()), pa.array([c[at[k] : at[k + 1]].tobytes() for k in some], pa.binary())], names=["bucket", "batch", "h", "c"])

    return count


def _totals(t):
    """To each batch, those of its shingles that two or more representatives hold, with their number."""
    import numpy as np
    import pyarrow as pa

    hs, cs = [np.frombuffer(x, np.uint64) for x in t.column("h").to_pylist()], [np.frombuffer(x, np.uint32) for x in t.column("c").to_pylist()]
    h = np.concatenate(hs)
    u, inverse = np.unique(h, return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(cs), minlength=len(u)).astype(np.uint32)[inverse]
    ends, out_h, out_c = np.concatenate([[0], np.cumsum([len(x) for x in hs])]), [], []
    for x, s, e in zip(hs, ends[:-1], ends[1:]):
        keep = total[s:e] > 1
        out_h.append(x[keep].tobytes())
        out_c.append(total[s:e][keep].tobytes())
    return pa.table({"batch": t.column("batch"), "h": pa.array(out_h, pa.binary()), "c": pa.array(out_c, pa.binary())})


def prefix_length(df, base: int, least: int) -> int:
    """l of least estimated cost. df: frequencies in prefix order; base: n - ceil(0.8 n); least: ceil(0.8 n)."""
    import numpy as np

    ls = np.arange(1, min(least, MOST) + 1)
    entries = np.cumsum(df.astype(np.float64) - 1)[base + ls - 1]
    return int(ls[np.argmin(entries + VERIFY * entries / ls)])


POSTINGS = "h long, doc long, n long, shared long, l int, typical double"


def _postings(left, right):
    """Prefix entries of a batch's documents: those of frequency 1 stand first in the order and need no entry."""
    import numpy as np
    import pyarrow as pa

    columns: list[list] = [[] for _ in range(6)]
    known = [(np.frombuffer(h, np.uint64), np.frombuffer(c, np.uint32)) for h, c in zip(right.column("h").to_pylist(), right.column("c").to_pylist())]
    hs = np.concatenate([h for h, _ in known]) if known else np.zeros(0, np.uint64)
    cs = np.concatenate([c for _, c in known]) if known else np.zeros(0, np.uint32)
    order = np.argsort(hs)
    hs, cs = hs[order], cs[order]
    for d, n, blob in zip(left.column("d").to_pylist(), left.column("n").to_pylist(), left.column("h").to_pylist()):
        ids, sizes, h = np.frombuffer(d, np.int64), np.frombuffer(n, np.int64), np.frombuffer(blob, np.uint64)
        at = np.searchsorted(hs, h)
        at[at == len(hs)] = 0
        df = np.where(hs[at] == h, cs[at], 1) if len(hs) else np.ones(len(h), np.uint32)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for i, s, e in zip(ids.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
            x, f, size = h[s:e], df[s:e], e - s
            shared, least = int((f > 1).sum()), need(size)
            if shared < least:
                continue
            order = np.lexsort((x, f))
            l = prefix_length(f[order], size - least, least)
            take = order[: size - least + l]
            take = take[f[take] > 1]
            k = len(take)
            for c, v in zip(columns, (x[take].view(np.int64), np.full(k, i), np.full(k, size), np.full(k, shared), np.full(k, l, np.int32), np.full(k, np.log(f).mean()))):
                c.append(v)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
    return pa.table({name.split()[0]: pa.array(np.concatenate(c) if c else np.zeros(0), k) for name, c, k in zip(POSTINGS.split(", "), columns, kinds)})


def _pairs(key, t):
    """Pairs of one cell, a document of side 0 and one of side 1 (or two of one block), with the number of prefix shingles they share under this hub."""
    import numpy as np
    import pyarrow as pa

    out: list[list] = [[] for _ in range(4)]
    t = t.sort_by([("hub", "ascending")])
    hubs = t.column("hub").to_numpy()
    cols = {c: t.column(c).to_numpy() for c in ("h", "doc", "n", "shared", "l", "overlap", "label", "side")}
    same = bool(key[3].as_py())
    starts = np.flatnonzero(np.concatenate(([True], hubs[1:] != hubs[:-1])))
    for s, e in zip(starts, np.append(starts[1:], len(hubs))):
        sides = []
        tokens, token = np.unique(cols["h"][s:e], return_inverse=True)
        for side in ((0,) if same else (0, 1)):
            here = s + np.flatnonzero(cols["side"][s:e] == side)
            docs, first, own = np.unique(cols["doc"][here], return_index=True, return_inverse=True)
            sides.append((docs, own, token[here - s], {c: cols[c][here][first] for c in ("n", "shared", "l", "overlap", "label")}))
        (da, oa, ta, a), (db, ob, tb, b) = sides[0], sides[-1]
        if not len(da) or not len(db):
            continue
        shared = np.zeros((len(da), len(db)), np.float32)
        for lo in range(0, len(tokens), 4096):
            shared += _incidence(oa, ta, len(da), len(tokens), lo) @ _incidence(ob, tb, len(db), len(tokens), lo).T
        na, nb = a["n"][:, None], b["n"][None, :]
        fits = (shared > 0) & (a["label"][:, None] != b["label"][None, :]) & (5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb))
        # overlap is at least 4/9 of the summed sizes; it is no larger than what both share with anybody,
        # nor than what both share with the hub and the rest that both share with anybody
        fits &= 9 * np.minimum(a["shared"][:, None], b["shared"][None, :]) >= 4 * (na + nb)
        known = (a["overlap"] >= 0)[:, None] & (b["overlap"] >= 0)[None, :]
        bound = np.minimum(a["overlap"][:, None], b["overlap"][None, :]) + np.minimum((a["shared"] - a["overlap"])[:, None], (b["shared"] - b["overlap"])[None, :])
        fits &= ~known | (9 * bound >= 4 * (na + nb))
        i, j = np.nonzero(fits)
        keep = da[i] < db[j] if same else da[i] != db[j]
        i, j = i[keep], j[keep]
        for c, v in zip(out, (np.minimum(da[i], db[j]), np.maximum(da[i], db[j]), shared[i, j].astype(np.int64), np.minimum(a["l"][i], b["l"][j]).astype(np.int64))):
            c.append(v)
    return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for c, v in zip(("a", "b", "found", "l"), out)})


def _incidence(own, token, docs: int, tokens: int, lo: int):
    import numpy as np

    keep = (token >= lo) & (token < lo + 4096)
    m = np.zeros((docs, min(4096, tokens)), np.float32)
    m[own[keep], token[keep] - lo] = 1
    return m


def _overlaps(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """a, b, na, nb, both: pairs with the sizes of their sets and of the intersection."""
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", both.alias("both"))


LINKED = "100 * both >= 80 * (na + nb - both)"


def link_components(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    work = Workspace(docs.sparkSession, "ngram-ids")
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    named = texts.filter("doc_id IS NOT NULL")
    repeated = work.write(named.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id"), "repeated")
    n_repeated = repeated.count()
    if not n_repeated:
        return _link_texts(texts, words)
    # every distinct text of a repeated id is joined under a number that no document has; then the id links its numbers
    numbered = work.write(dense_ids(named.join(small(repeated, n_repeated), "doc_id", "left_semi"), ["doc_id", "text"], "number"), "numbered")
    n_numbered = numbered.count()
    numbered = numbered.withColumn("number", F.col("number") + F.lit(_free(named, n_numbered)).cast("long"))
    once = named.join(small(repeated, n_repeated), "doc_id", "left_anti").select("doc_id", "text")
    linked = _link_texts(once.unionByName(numbered.select(F.col("number").alias("doc_id"), "text")), words)
    owners = numbered.select(F.col("number").alias("doc_id"), F.col("doc_id").alias("owner"))
    linked = work.write(linked.join(small(owners, n_numbered), "doc_id", "left"), "linked")
    merged = components(linked.filter("owner IS NOT NULL").select(F.col("component_id").alias("a"), F.col("owner").alias("b")), work, "merged")
    label = F.coalesce("component", "component_id").alias("label")
    labelled = linked.join(merged.withColumnRenamed("node", "component_id"), "component_id", "left").select(F.coalesce("owner", "doc_id").alias("doc_id"), "n_shingles", label)
    labelled = work.write(labelled.groupBy("doc_id").agg(F.max("n_shingles").alias("n"), F.min("label").alias("label")), "labelled")
    least = labelled.groupBy("label").agg(F.min("doc_id").alias("component"))
    out = texts.select("doc_id").join(labelled.join(least, "label").select("doc_id", "n", "component"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _free(named: DataFrame, n: int) -> int:
    """The first of n numbers in a row that are no doc_id."""
    import random

    most = named.agg(F.max("doc_id")).first()[0]
    if most + n < 2**63:
        return most + 1
    r = random.Random(n)
    while True:
        k = r.randrange(-(2**63), 2**63 - n)
        if named.filter(F.col("doc_id").between(k, k + n)).isEmpty():
            return k


def _link_texts(texts: DataFrame, words: int) -> DataFrame:
    """The same where no two rows share an id."""
    spark = texts.sparkSession
    work = Workspace(spark, "ngram")
    named = texts.filter("doc_id IS NOT NULL")
    buckets = 2 * partitions(spark)

    blobs = named.mapInArrow(_publish(buckets, words), "bucket int, facts boolean, h binary, d binary, m binary")
    found = blobs.groupBy("bucket").applyInArrow(_screen(buckets), "part int, d binary, n binary, m binary")
    stats = work.write(found.groupBy("part").applyInArrow(_gather, "doc_id long, n long, matched long"), "stats")
    least = F.ceil(F.col("n") * 4 / 5)  # of the document; a partner has no fewer than this many shingles
    survivors = stats.filter(F.col("matched") >= F.greatest(F.lit(1), F.floor(F.ceil(least * 4 / 5) / SHARE))).select("doc_id")
    n_survivors = survivors.count()

    sets = named.join(small(survivors, n_survivors), "doc_id", "left_semi").mapInArrow(_sets(words), "doc_id long, n long, c1 long, c2 long, s array<long>")
    sets = work.write(sets.filter("n > 0"), "sets")
    key = ["n", "c1", "c2"]
    one = sets.select("doc_id", *key)
    classes = work.write(one.groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")
    n_classes = classes.count()
    copies = one.join(small(classes, n_classes), key).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    mine = classes.withColumnRenamed("rep", "doc_id")
    # a set of one shingle links with equal sets only, which are its class
    reps = sets.filter("n > 1").join(small(mine, n_classes), ["doc_id", *key], "left_semi")
    reps = work.write(reps.select("doc_id", "n", "s"), "reps")

    packed = work.write(reps.select("doc_id", "s").mapInArrow(_batches, "batch long, d binary, n binary, h binary"), "batches")
    counted = packed.select("batch", "h").mapInArrow(_count(buckets), "bucket int, batch long, h binary, c binary")
    frequent = counted.groupBy("bucket").applyInArrow(_totals, "batch long, h binary, c binary")
    postings = work.write(packed.groupBy("batch").cogroup(frequent.groupBy("batch")).applyInArrow(_postings, POSTINGS), "postings")
    hubs = postings.groupBy("h").agg(F.min(F.struct(-F.col("typical"), "n", "doc")).alias("x"), F.count("*").alias("k")).filter("k > 1").select("h", F.col("x.doc").alias("hub"))
    entries = work.write(postings.join(hubs, "h").drop("typical"), "entries")

    stars = entries.filter("doc <> hub").select(F.col("doc").alias("a"), F.col("hub").alias("b")).distinct()
    checked = work.write(_overlaps(stars, reps), "checked")
    first = checked.filter(LINKED).select("a", "b")
    labels = components(first, work, "first")
    labels = labels.select(F.col("node").alias("doc"), F.col("component").alias("label"))
    overlap = checked.groupBy(F.col("a").alias("doc"), F.col("b").alias("hub")).agg(F.max("both").alias("overlap"))
    known = entries.join(labels, "doc", "left").join(overlap, ["doc", "hub"], "left")
    known = known.withColumns({"label": F.coalesce("label", "doc"), "overlap": F.when(F.col("doc") == F.col("hub"), F.col("n")).otherwise(F.coalesce("overlap", F.lit(-1)))})
    own = labels.select(F.col("doc").alias("hub"), F.col("label").alias("hub_label"))
    known = work.write(known.join(own, "hub", "left").withColumn("other", (F.col("label") != F.coalesce("hub_label", "hub")).cast("int")).drop("hub_label"), "known")
    held = known.groupBy("hub", "doc", "other").agg(F.count("*").alias("k")).groupBy("hub", "other").agg(F.count("*").alias("docs"), F.sum("k").alias("k"))
    held = held.withColumn("blocks", F.greatest(F.ceil(F.col("docs") / CELL), F.ceil(F.col("k") / ENTRIES)).cast("int"))
    blocks = held.groupBy("hub").agg(F.max(F.when(F.col("other") == 1, F.col("blocks"))).alias("fs"), F.coalesce(F.max(F.when(F.col("other") == 0, F.col("blocks"))), F.lit(1)).alias("ns")).filter("fs > 0")
    n_hubs = blocks.count()
    placed = known.join(small(blocks, n_hubs), "hub")
    block = F.pmod(F.xxhash64("doc"), F.when(F.col("other") == 1, F.col("fs")).otherwise(F.col("ns"))).cast("int")
    placed = placed.withColumn("block", block)
    # cells: (near block, far block), (far block, later far block), and far blocks with themselves
    span = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    zero, last = F.lit(0), F.col("fs") - 1
    cell = lambda i, j, same, side, kind: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(same).alias("same"), F.lit(side).alias("side"))
    near_cells = F.transform(span(zero, last), lambda j: cell(F.col("block"), j, 0, 0, 0))
    far_cells = F.concat(
        F.transform(span(zero, F.col("ns") - 1), lambda i: cell(i, F.col("block"), 0, 1, 0)),
        F.transform(span(F.col("block") + 1, last), lambda j: cell(F.col("block"), j, 0, 0, 1)),
        F.transform(span(zero, F.col("block") - 1), lambda i: cell(i, F.col("block"), 0, 1, 1)),
        F.array(cell(F.col("block"), F.col("block"), 1, 0, 1)),
    )
    # small hubs share groups; a hub with several blocks has a group for each cell
    lone = (F.col("fs") > 1) | (F.col("ns") > 1)
    spread = placed.select("*", F.explode(F.when(F.col("other") == 1, far_cells).otherwise(near_cells)).alias("cell")).select("h", "doc", "n", "shared", "l", "overlap", "label", "hub", "cell.*", F.when(lone, F.col("hub")).otherwise(F.pmod(F.xxhash64("hub"), F.lit(buckets))).alias("group"), lone.cast("int").alias("lone"))
    pairs = spread.groupBy("group", "i", "j", "same", "kind", "lone").applyInArrow(_pairs, "a long, b long, found long, l long")
    enough = pairs.groupBy("a", "b").agg(F.sum("found").alias("found"), F.min("l").alias("l")).filter("found >= l").select("a", "b")
    second = work.write(_overlaps(enough, reps).filter(LINKED).select("a", "b"), "second")

    final = components(copies.unionByName(first).unionByName(second), work, "final")
    out = texts.select("doc_id").join(stats.select("doc_id", "n"), "doc_id", "left").join(final.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
