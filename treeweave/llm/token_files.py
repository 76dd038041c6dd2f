"""Token-id files: Re-Pair grammar compression by shard, with expansion lengths for random access.

A shard holds the ids of neighbouring documents in ascending doc_id order. Frequent pairs of symbols are replaced by
nonterminals, the most frequent first, until no pair occurs MIN_COUNT times. Symbols are unsigned 16-bit: the vocabulary's ids, then
the shard's rules.

A shard is one row of a Parquet folder, so Spark's commit protocol makes the write atomic and restartable:
part, block: the shard's place; first_id, last_id: its least and greatest doc_id; n_ids; doc_ids: signed 64-bit, id_nulls: one byte each; n_tokens: unsigned 32-bit, ids of each document;
rules: pairs of symbols (rule k defines symbol base + k); lengths: expansion length of each rule, unsigned 32-bit;
symbols: the compressed sequence; marks: ids expanded before every MARK-th symbol, unsigned 64-bit.

Defined cases: null or empty texts are the end id alone; null doc_ids come first; repeated rows follow one another;
an empty table gives no shards. Only doc_id and text are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .column_codec import column_codec
from .common import partitions, release, small

END = 2
SHARD_IDS = 2_000_000  #: ids after which a shard ends, with its document
MIN_COUNT = 32  #: the price of a rule: pairs that occur less often stay as they are
MIN_USES = 8  #: places that a rule must replace, once pairs that touch others have given way: so much its 8 bytes cost twice over
TOP = 1024  #: pairs that occur so often get their rules first
MARK = 1024
SCHEMA = "part int, block int, first_id long, last_id long, n_ids long, base int, doc_ids binary, id_nulls binary, n_tokens binary, rules binary, lengths binary, symbols binary, marks binary"


HASH, SLOTS = 0x9E3779B1, 20


def _chosen(where, rank):
    """Which of the ascending places to replace: no two that touch, and of touching ones the pair of the smaller rank."""
    import numpy as np

    out = np.ones(len(where), bool)
    touch = np.diff(where) == 1
    near = np.zeros(len(where), bool)
    near[1:] = touch
    near[:-1] |= touch
    left = np.flatnonzero(near).astype(np.int32)  # those alone are replaced
    out[left] = False
    same = np.zeros(len(left), bool)
    same[1:] = (np.diff(where[left]) == 1) & (np.diff(rank[left]) == 0)
    if same.any():  # of one pair again and again every second, from the left
        at = np.arange(len(left), dtype=np.int32)
        first = np.flatnonzero(~same)[np.cumsum(~same) - 1]
        left = left[(at - first) % 2 == 0]
    while len(left):
        w, r = where[left], rank[left]
        touch, up = np.diff(w) == 1, r[1:] > r[:-1]
        won = np.ones(len(left), bool)
        won[1:] = ~(touch & up)
        won[:-1] &= ~touch | up
        out[left[won]] = True
        rest = ~won
        rest[1:] &= ~(touch & won[:-1])
        rest[:-1] &= ~(touch & won[1:])
        left = left[rest]
    return out


def repair(ids, base: int, min_count: int = MIN_COUNT, min_uses: int = MIN_USES, top: int = TOP):
    """(symbols, rules, lengths) of an array of ids, all under base; base and the number of rules together stay under 65,536.

    A pass makes rules for all pairs that occur at least `least` times. That limit falls from top to min_count by quarters; at min_count
    passes go on until no pair is left that reaches it, and look only at pairs that can have become frequent: those with a new symbol
    and those that gave way to others. Touching pairs go to the more frequent one; a pair left with under min_uses places gets no rule in
    that pass. The most frequent pair of a pass keeps at least half of its places, so every pass makes a rule.
    """
    import numpy as np

    shift, hash_ = np.uint32(32 - SLOTS), np.uint32(HASH)
    seq = ids.astype(np.uint16)
    size, made, rules = np.ones(65_536, np.uint32), 0, [np.zeros((0, 2), np.uint16)]
    least, at = max(min_count, top), None
    table = np.full(1 << SLOTS, -1, np.int16)  # the hashed number of a pair; there are under 2**15 new symbols
    while len(seq) > 1 and (room := min(65_536 - base - made, 2**15 - 1)) > 0:
        some = seq[:-1].astype(np.uint32) if at is None else seq[at].astype(np.uint32)
        some <<= np.uint32(16)
        some |= seq[1:] if at is None else seq[at + 1]
        ordered = np.sort(some)
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))
        counts = np.diff(np.append(starts, len(ordered)))
        often = np.flatnonzero(counts >= least)
        if not len(often):
            if least == min_count:
                break
            least = max(min_count, least // 4)
            continue
        often = often[np.argsort(-counts[often], kind="stable")[:room]]
        keys = ordered[starts[often]]
        slot = (keys * hash_) >> shift
        table[slot[::-1]] = np.arange(len(keys) - 1, -1, -1, dtype=np.int16)
        which = table[(some * hash_) >> shift]
        lost = np.sort(keys[table[slot] != np.arange(len(keys))])  # another, more frequent pair has their slot: they wait for the next pass
        table[slot] = -1
        k = np.flatnonzero(which >= 0)
        which = which[k]
        exact = keys[which] == some[k]
        waiting = k[~exact]
        waiting = waiting[np.isin(some[waiting], lost)]
        k, which = k[exact], which[exact]
        where, waiting = (k, waiting) if at is None else (at[k], at[waiting])
        pick = _chosen(where, which)
        good = np.bincount(which[pick], minlength=len(keys)) >= min(min_uses, min_count // 2)
        mine = good[which]
        if not mine.all():
            waiting = np.concatenate([waiting, where[~mine]])
            where, which = where[mine], which[mine]
            pick = _chosen(where, which)
            good = np.bincount(which[pick], minlength=len(keys)) > 0
        where, which = where[pick], (np.cumsum(good) - 1)[which[pick]]
        keys, new = keys[good], base + made
        left, right = keys >> np.uint32(16), keys & np.uint32(65_535)
        size[new : new + len(keys)] = size[left] + size[right]
        rules.append(np.stack([left, right], 1).astype(np.uint16))
        made += len(keys)
        seq[where] = (new + which).astype(np.uint16)
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        if least > min_count:
            least = max(min_count, least // 4)
        else:
            here = where - np.arange(len(where), dtype=np.int32)  # places are ascending, and one symbol goes behind each
            waiting = waiting[keep[waiting]]
            look = np.zeros(len(seq) - len(where), bool)
            look[here] = look[here - 1] = look[waiting - np.searchsorted(where, waiting - 1)] = True
            look[-1] = False
            at = np.flatnonzero(look).astype(np.int32)
        seq = seq[keep]
    return seq, np.concatenate(rules), size[base : base + made]


class Shard:
    """Decodes a shard, whole or from a place on."""

    def __init__(self, base: int, rules: bytes, lengths: bytes, symbols: bytes, marks: bytes):
        import numpy as np

        self.base, self.np = base, np
        self.rules = np.frombuffer(rules, "<u2").reshape(-1, 2).astype(np.int64)
        self.lengths = np.concatenate([np.ones(base, np.int64), np.frombuffer(lengths, "<u4").astype(np.int64)])
        self.symbols, self.marks = np.frombuffer(symbols, "<u2"), np.frombuffer(marks, "<u8").astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.table = np.zeros(self.offsets[-1], np.uint16)
        self.table[:base] = np.arange(base)
        k, latest = 0, self.rules.max(1, initial=0)
        while k < len(self.rules):  # rules name earlier symbols only: block by block, each of which names none of its own
            later = np.flatnonzero(latest[k:] >= base + k)
            stop = k + int(later[0]) if len(later) else len(self.rules)
            self.table[self.offsets[base + k] : self.offsets[base + stop]] = self.expand(self.rules[k:stop].ravel())
            k = stop

    def expand(self, symbols):
        np = self.np
        n = self.lengths[symbols]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(n) else 0
        return self.table[np.repeat(self.offsets[symbols] - (ends - n), n) + np.arange(total)]

    def ids(self):
        return self.expand(self.symbols)

    def slice(self, start: int, stop: int):
        """ids[start:stop] from the symbols that cover them: the marks give the first, expansion lengths the last."""
        np = self.np
        k = (int(np.searchsorted(self.marks, start, "right")) - 1) * MARK
        last = int(np.searchsorted(self.marks, stop, "left")) * MARK
        got = self.expand(self.symbols[k:last])
        at = start - int(self.marks[k // MARK])
        return got[at : at + stop - start]


def _encode(vocabulary: str | None, end: int, shard_ids: int):
    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        columns, tail, part, block = column_codec(vocabulary), np.array([end], "<u2").tobytes(), TaskContext.get().partitionId(), 0
        bpe = columns.bpe
        names, coded, held = [], [], 0

        def row() -> pa.RecordBatch:
            seq, rules, lengths = repair(np.frombuffer(b"".join(coded), "<u2"), bpe.size)
            size = np.concatenate([np.ones(bpe.size, np.uint64), lengths.astype(np.uint64)])
            before = np.concatenate([[0], np.cumsum(size[seq])]).astype("<u8")[:-1:MARK]
            known = [x for x in (names[names.count(None)] if names[-1] is not None else None, names[-1]) if x is not None] or [None] * 2
            values = [part, block, *known, held, bpe.size, np.array([x or 0 for x in names], "<i8").tobytes(), bytes(x is None for x in names), np.array([len(x) // 2 for x in coded], "<u4").tobytes(), rules.astype("<u2").tobytes(), lengths.astype("<u4").tobytes(), seq.astype("<u2").tobytes(), before.tobytes()]
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 3, pa.int32(), *[pa.binary()] * 7]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        for b in batches:
            for i, ids in columns.rows(b, "doc_id", "text"):
                names.append(i)
                coded.append(ids + tail)
                held += len(coded[-1]) // 2
                if held >= shard_ids:
                    yield row()
                    names, coded, held, block = [], [], 0, block + 1
        if names:
            yield row()
        names, coded = [], []
        release()

    return encode


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END, shard_ids: int = SHARD_IDS, shards: int | None = None) -> None:
    """Parts are ranges of (doc_id, hash of the text), so that rows repeating one id are dealt over parts too."""
    hashed = docs.select(F.col("doc_id").cast("long"), "text").withColumn("_h", F.xxhash64("text"))
    parts = hashed.repartitionByRange(shards or 2 * partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), F.col("_h").asc()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("_h").asc())
    parts.select("doc_id", "text").mapInArrow(_encode(vocabulary, end, shard_ids), SCHEMA).write.mode("overwrite").parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _starts(files: DataFrame) -> DataFrame:
    """part, block and the ids before it, from sums by part and then within the part."""
    blocks = files.select("part", "block", "n_ids")
    per = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row for each part of the write: as many as it had tasks
    before = per.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_before"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")
    return blocks.join(before, "part").select("part", "block", (F.col("_before") + within).alias("_start"))


def document_digests(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the decoded shards."""

    def decode(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                ids = Shard(r["base"], r["rules"], r["lengths"], r["symbols"], r["marks"]).ids().astype("<u4")
                n = np.frombuffer(r["n_tokens"], "<u4").astype(np.int64)
                ends = np.cumsum(n)
                crcs = [zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(ends.tolist(), n.tolist())]
                names = pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=np.frombuffer(r["id_nulls"], np.uint8).astype(bool))
                m = len(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, r["part"], np.int32)), pa.array(np.full(m, r["block"], np.int32)), names, pa.array(ends - n), pa.array(n), pa.array(crcs, pa.int64())], names=["part", "block", "doc_id", "_in", "n_tokens", "ids_crc32"])

    files = read_token_files(spark, path)
    starts = _starts(files)
    decoded = files.select("part", "block", "base", "doc_ids", "id_nulls", "n_tokens", "rules", "lengths", "symbols", "marks").mapInArrow(decode, "part int, block int, doc_id long, _in long, n_tokens long, ids_crc32 long")
    n_blocks = files.count()
    return decoded.join(small(starts, n_blocks), ["part", "block"]).select("doc_id", (F.col("_start") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark, path: str, doc_id: int) -> list[list[int]]:
    """ids of the documents with this id. Only shards whose range of ids holds it are read, and only the symbols that cover it are expanded, by the executors."""

    def decode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                names, n = np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["n_tokens"], "<u4").astype(np.int64)
                at = np.flatnonzero((names == doc_id) & (np.frombuffer(r["id_nulls"], np.uint8) == 0))
                if len(at):
                    shard, ends = Shard(r["base"], r["rules"], r["lengths"], r["symbols"], r["marks"]), np.cumsum(n)
                    found = [shard.slice(int(ends[k] - n[k]), int(ends[k])).astype(np.int32) for k in at]
                    yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * len(at), pa.int32()), pa.array([r["block"]] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["part", "block", "k", "ids"])

    near = read_token_files(spark, path).filter(F.lit(doc_id).between(F.col("first_id"), F.col("last_id")))
    wanted = near.select("part", "block", "base", "doc_ids", "id_nulls", "n_tokens", "rules", "lengths", "symbols", "marks")
    return [r.ids for r in wanted.mapInArrow(decode, "part int, block int, k long, ids array<int>").orderBy("part", "block", "k").collect()]
