"""Token counts by source, language and tokenizer version, kept as delta-maintained rollups.

Every change is a signed delta: an insert adds a document and its tokens, a delete subtracts both, a revised count
subtracts the old number and adds the new one. A batch is summed by key before it is written, and its folder carries
its id, so committing the same id again changes nothing. Totals are the sum of the batches' deltas; compact() folds
them into one. Counting uses DataFrame operations only; a BPE counter is there too.

Defined cases: null source or language is a key of its own; null or empty texts count 0 tokens and 1 document; a
repeated row is counted again; an empty batch commits and changes nothing; keys whose documents and tokens are both
back at 0 leave the totals. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import codec, n_words

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


def n_alnum(text: Column) -> Column:
    """Runs of ASCII letters or digits, and every other character that is neither white space nor these."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]")), F.lit(0)).cast("long")


#: Tokenizer versions that SQL can express.
TOKENIZERS = {"words@1": n_words, "alnum@1": n_alnum}


def bpe_counts(docs: DataFrame, text: str = "text", vocabulary: str | None = None, name: str = "n_tokens") -> DataFrame:
    """docs without its text, and the number of its BPE ids."""
    kept = [c for c in docs.columns if c != text]

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = codec(vocabulary)
        for b in batches:
            n = pa.array([len(bpe.encode(t)) // 2 for t in b.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], n], names=[*kept, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)
    return docs.mapInArrow(count, f"{fields}, {name} long")


def inserts(counts: DataFrame, tokenizer: str, tokens: str) -> DataFrame:
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("docs"), F.col(tokens).cast("long").alias("tokens"))


def deletes(counts: DataFrame, tokenizer: str, tokens: str) -> DataFrame:
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(-1).cast("long").alias("docs"), (-F.col(tokens)).cast("long").alias("tokens"))


def revisions(counts: DataFrame, tokenizer: str, old: str, new: str) -> DataFrame:
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(0).cast("long").alias("docs"), (F.col(new) - F.col(old)).cast("long").alias("tokens"))


def _summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class TokenRollup:
    """Committed batches under `path`, a folder that all executors share.

    A batch is written to a staging folder and then renamed to batch-<id>: it is seen whole or not at all where renaming a folder is one
    step, as in HDFS or a local file system (in most object stores it isn't). One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._at("x").getFileSystem(self._conf)
        self._fs.mkdirs(jvm.org.apache.hadoop.fs.Path(self.path))

    def _found(self) -> tuple[list[str], list[str], list[str]]:
        """Folders that count, ids of the batches that the latest folded one of them replaces, and folders so replaced that are still there."""
        names = sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(self._at(".")) if s.isDirectory()) if n.startswith("batch-"))
        folded = sorted((n for n in names if n.startswith("batch-+")), key=lambda n: int(n[7:]))
        ids = [r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.path}/{folded[-1]}/ids").collect()] if folded else []
        replaced = {f"batch-{i}" for i in ids} | set(folded[:-1])
        return [n for n in names if n not in replaced], ids, [n for n in names if n in replaced]

    def _names(self) -> list[str]:
        return self._found()[0]

    def batches(self) -> list[str]:
        """Ids of committed batches; those folded by compact() included."""
        names, ids, _ = self._found()
        return sorted({n[6:] for n in names if not n.startswith("batch-+")} | set(ids))

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """False, and nothing is changed, if the batch had been committed before."""
        if not batch or batch[0] == "+" or "/" in batch:
            raise ValueError("a batch id is a plain name")
        if batch in self.batches():
            return False
        self._fs.delete(self._at(f"staging-{batch}"), True)
        _summed(deltas).write.parquet(f"{self.path}/staging-{batch}/deltas")
        self._rename(f"staging-{batch}", f"batch-{batch}")
        return True

    def _rename(self, old: str, new: str) -> None:
        if not self._fs.rename(self._at(old), self._at(new)):
            raise OSError(f"{self.path}/{old} could not be renamed to {new}")

    def _deltas(self) -> DataFrame:
        names = self._names()
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{n}/deltas" for n in names])

    def totals(self) -> DataFrame:
        return _summed(self._deltas()).filter("docs <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """Folds all batches into one; the ids stay known. The folded batch names those that it replaces, so from its rename on they no longer
        count, and an interrupted call leaves either the batches or the folded one; the next call deletes what is left over."""
        names, _, gone = self._found()
        ids = self.batches()
        name = f"+{len(ids)}"
        if names and names != [f"batch-{name}"]:
            self._fs.delete(self._at(f"staging-{name}"), True)
            self.totals().write.parquet(f"{self.path}/staging-{name}/deltas")
            self.spark.createDataFrame([(i,) for i in ids], "batch string").coalesce(1).write.parquet(f"{self.path}/staging-{name}/ids")
            self._rename(f"staging-{name}", f"batch-{name}")
            gone = gone + names
        for n in gone:
            self._fs.delete(self._at(n), True)
