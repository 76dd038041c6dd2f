"""Sharding by extendible hashing: only oversized buckets split on another hash bit. DataFrame operations only.

A bucket is a prefix of the bits of a row's hash. It is a shard if its rows hold at most limit bytes, or if it is a
single row (a row larger than the limit has a shard of its own). The first 60 bits come from md5 of the key; rows
that still share a bucket, i.e. repeat a key, go on with 60 bits from the row's number in the written size table,
so that a key with a third of all rows splits too.

Defined cases: a null key counts as the empty one, a null or empty text has 0 bytes; an empty table has no shards;
repeated rows are rows of their own. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, small

BITS = 60
CELLS = 100_000  #: largest part of the directory that is broadcast: rows hold a prefix as text, under 200 bytes, so 20 MB at most; a larger one is joined by prefix


def key_bits(key: Column) -> Column:
    """60 bits as text, from the first 15 hex digits of md5."""
    digits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 2)
    return F.lpad(digits, BITS, "0")


def assign_shards(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text", ahead: int = 4, number: str | None = None) -> DataFrame:
    """key, n_bytes, depth, shard (its hash prefix, of depth bits) for each row; with number, a column that numbers the rows, it too.

    The texts are read once; the passes below go over the written sizes. A pass sums the rows left by the prefix that
    the total calls for, plus `ahead` bits; sums of shorter prefixes come from these sums. Buckets that are still
    too large go to the next pass alone. The directory stays a table: it has at most a few times total / limit rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "shards")
    bits = F.concat(key_bits(F.col(key)), key_bits(F.col(number) if number else F.monotonically_increasing_id()))
    kept = [key, number] if number else [key]
    left = work.write(docs.select(*kept, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), bits.alias("_bits")), "sizes")
    total = left.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    out, done, step = [], 0, 0
    while True:
        depth = min(2 * BITS, done + max(0, (-(-total.n // limit) - 1).bit_length()) + ahead)
        cells = left.groupBy(F.substring("_bits", 1, depth).alias("_cell")).agg(F.sum("n_bytes").alias("_n"), F.count("*").alias("_rows"))
        spread = cells.select("_n", "_rows", F.explode(F.sequence(F.lit(done), F.lit(depth))).alias("_d"), "_cell")
        sums = spread.groupBy("_d", F.substring("_cell", F.lit(1), F.col("_d")).alias("_shard")).agg(F.sum("_n").alias("_n"), F.sum("_rows").alias("_rows"))
        fits = sums.filter((F.col("_n") <= limit) | (F.col("_rows") == 1) | (F.col("_d") == 2 * BITS)).select("_d", "_shard")
        ways = cells.select("_cell", F.explode(F.sequence(F.lit(done), F.lit(depth))).alias("_d")).select("_cell", "_d", F.substring("_cell", F.lit(1), F.col("_d")).alias("_shard"))
        directory = work.write(ways.join(fits, ["_d", "_shard"], "left_semi").groupBy("_cell").agg(F.min("_d").alias("depth")), f"directory{step}")
        n_cells = directory.count()
        joined = left.withColumn("_cell", F.substring("_bits", 1, depth)).join(small(directory, n_cells, CELLS), "_cell", "left")
        out.append(joined.filter("depth IS NOT NULL").select(*kept, "n_bytes", "depth", F.substring("_bits", F.lit(1), F.col("depth")).alias("shard")))
        if cells.join(small(directory, n_cells, CELLS), "_cell", "left_anti").isEmpty():
            break
        left = work.write(joined.filter("depth IS NULL").select(*kept, "n_bytes", "_bits"), f"left{step}")
        total = left.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
        done, step = depth + 1, step + 1
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def write_shards(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes every row of docs into one folder for each shard, b<prefix> of the column shard (with as many _ behind it as docs' own columns call for);
    returns the assignment. The rows are numbered and written once before, so that null and repeated keys find their own shard."""
    work = Workspace(docs.sparkSession, "shard-rows")
    number, column = (_free(name, docs.columns) for name in ("_row", "shard"))
    rows = work.write(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    shards = work.write(assign_shards(rows, limit, key, text, number=number), "shards")
    named = shards.select(F.col(number).alias("n"), F.concat(F.lit("b"), "shard").alias("s"))
    out = rows.alias("r").join(named.alias("s"), F.col(f"r.{number}") == F.col("s.n")).select(*[F.col(f"r.`{c}`") for c in docs.columns], F.col("s.s").alias(column))
    out.repartition(column).write.mode("overwrite").partitionBy(column).parquet(path)
    return shards.drop(number)


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name
