"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join. DataFrame operations only.

A listed entry is a host and a path prefix with a verdict. It fits a URL whose host is that host or a subdomain of it
and whose path starts with that path; the longest fitting entry (host and path together) wins. A URL without a
fitting entry gets the default verdict.

Defined cases: a null URL, or one without "://", has an empty host and path and so fits only entries with an empty
host; repeated rows each get their row; an empty table gives no rows; columns of the input are kept, but host, path,
rule and verdict replace columns of these names. Two equal entries: blocking wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small

WORDS = 8  #: 64-bit words of a block: one cache line; each key sets one bit of each word
FILTER_BLOCKS = 1_000_000  #: largest filter that is broadcast (64 bytes a block); a larger one is joined by block


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    """One bit for each word of the block, from 6 bits each of a second hash."""
    h = F.xxhash64(F.lit(17), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def build_filter(keys: DataFrame, n_keys: int, bits_per_key: int = 16) -> tuple[DataFrame, int]:
    """(block, w0..w7) of the column key, and the number of blocks. Bits are or-ed before and after the shuffle."""
    blocks = max(1, -(-n_keys * bits_per_key // (64 * WORDS)))
    masks = keys.select(_block(F.col("key"), blocks).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(_masks(F.col("key")))])
    return masks.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def probe(keys: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows of keys that may be listed: no listed key is lost, some others pass."""
    hit = F.lit(True)
    for i, m in enumerate(_masks(F.col("key"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) == m)
    hashed = keys.withColumn("block", _block(F.col("key"), blocks))
    return hashed.join(small(bloom, blocks, FILTER_BLOCKS), "block").filter(hit).select(*keys.columns)


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """All host suffixes at label bounds, each with all prefixes of the path that have a listed length; "#", which neither has, stands between."""
    labels = F.split(host, r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    paths = F.transform(cuts, lambda n: F.substring(path, F.lit(1), n))
    return F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, F.lit("#"), p)))))


def filter_urls(pages: DataFrame, listed: DataFrame, url: str = "url", default: str = "allow", bits_per_key: int = 16) -> DataFrame:
    """pages with host, path, rule (null where none fits) and verdict. listed: host, path, verdict.

    Candidates are made once for each distinct host and path, so that a hot page or host is looked up once. The list
    is broadcast only after it has been counted; else both joins shuffle, where AQE splits hot keys.
    """
    entries = listed.select(F.concat("host", F.lit("#"), "path").alias("key"), F.length("path").alias("n"), "verdict").groupBy("key", "n").agg(F.max("verdict").alias("verdict"))
    found = entries.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("n")).alias("lengths")).first()  # lengths: at most as many as a URL has characters
    parts = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if not found.n:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    bloom, blocks = build_filter(entries.select("key"), found.n, bits_per_key)
    keys = parts.select("host", "path").distinct().select("host", "path", F.explode(candidate_keys(F.col("host"), F.col("path"), found.lengths)).alias("key"))
    exact = probe(keys, bloom, blocks).join(small(entries.select("key", "verdict"), found.n), "key")
    # the longest rule; of equally long ones that with the longer host
    best = exact.groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), F.instr("key", "#").alias("h"), "key", "verdict")).alias("best"))
    out = parts.alias("p").join(best.alias("b"), (F.col("p.host") == F.col("b.host")) & (F.col("p.path") == F.col("b.path")), "left")
    judged = {"rule": F.replace(F.col("b.best.key"), F.lit("#"), F.lit("")), "verdict": F.coalesce(F.col("b.best.verdict"), F.lit(default))}
    return out.select(*[F.col(f"p.`{c}`") for c in parts.columns if c not in judged], *[v.alias(c) for c, v in judged.items()])
