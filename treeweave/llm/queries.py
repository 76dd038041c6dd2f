"""One query for each operator, with production parameters, over whole tables; SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, mixing, ngram_join, packing, sharding, token_files, token_rollup, topk, toxicity, url_filter
from .common import Workspace, table

SHARD_LIMITS = (64 << 20, 64 << 10)  #: bytes of a shard: of a training run, and of a unit of work
WEIGHTS = [3.0, 1.0, 2.0]
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates are inserted, revised to counts by two tokenizer versions, and documents labelled toxic deleted; a replayed batch changes nothing."""
    work = Workspace(spark, "rollup")
    docs = table(spark, sf_dir, "documents")
    counted = docs.select("doc_id", "source", "lang", F.floor(F.coalesce("n_chars", F.lit(0)) / 6).cast("long").alias("estimate"), *[f(F.col("text")).alias(name) for name, f in token_rollup.TOKENIZERS.items()])
    counts = work.write(counted, "counts")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    gone = counts.join(toxic, "doc_id", "left_semi")
    rollup = token_rollup.TokenRollup(spark, f"{work.path}/rollup")
    for name in token_rollup.TOKENIZERS:
        revised = token_rollup.revisions(counts, name, "estimate", f"`{name}`")
        rollup.commit(f"insert-{name}", token_rollup.inserts(counts, name, "estimate"))
        rollup.commit(f"revise-{name}", revised)
        rollup.commit(f"revise-{name}", revised)
        rollup.commit(f"delete-{name}", token_rollup.deletes(gone, name, f"`{name}`"))
    return rollup.totals()


OP1_SQL = r"""
WITH t AS (
  SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w,
         len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]')) AS a
  FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1))
SELECT source, lang, 'words@1' AS tokenizer, CAST(count(*) AS BIGINT) AS docs, CAST(sum(w) AS BIGINT) AS tokens FROM t GROUP BY source, lang
UNION ALL
SELECT source, lang, 'alnum@1', CAST(count(*) AS BIGINT), CAST(sum(a) AS BIGINT) FROM t GROUP BY source, lang
"""


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict")


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}')"


_BY_LENGTH = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
OP2_SQL = rf"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages)
SELECT page_id, host, path,
  CASE {' '.join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for h, p, _ in _BY_LENGTH)} END AS rule,
  CASE {' '.join(f"WHEN {_fits(h, p)} THEN '{v}'" for h, p, v in _BY_LENGTH)} ELSE 'allow' END AS verdict
FROM p
"""


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = toxicity.score(docs, lexicon, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS).select("doc_id", "size", "source_size", "target", "taken")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), f"{work.path}/files")
    return token_files.document_digests(spark, f"{work.path}/files")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.q, b.q)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of each document for either limit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coarse, fine = (sharding.assign_shards(docs, n).select(F.lit(n).cast("long").alias("limit_bytes"), "*") for n in SHARD_LIMITS)
    return coarse.unionByName(fine)


OP10_SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
         lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)), 60, '0') AS bits
  FROM documents),
l(limit_bytes) AS (VALUES {', '.join(f'({n})' for n in SHARD_LIMITS)}),
b AS (
  SELECT limit_bytes, d, substr(bits, 1, d) AS shard FROM t, generate_series(0, 24) AS g(d), l
  GROUP BY limit_bytes, d, substr(bits, 1, d) HAVING sum(n_bytes) <= limit_bytes OR count(*) = 1)
SELECT CAST(limit_bytes AS BIGINT) AS limit_bytes, doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(length(shard) AS INTEGER) AS depth, shard
FROM (SELECT b.limit_bytes, t.doc_id, t.n_bytes, min_by(b.shard, b.d) AS shard FROM (SELECT row_number() OVER () AS r, * FROM t) t
      JOIN b ON b.shard = substr(t.bits, 1, b.d) GROUP BY b.limit_bytes, t.r, t.doc_id, t.n_bytes)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_url_filter, op3_nearest_neighbours, op4_ngram_join, op5_best_fit_packing, op6_toxicity, op7_mixing, op8_token_files, op9_exact_topk, op10_sharding)}
ORACLE_SQL: dict[str, str] = {"op1_token_counts": OP1_SQL, "op2_url_filter": OP2_SQL, "op9_exact_topk": OP9_SQL, "op10_sharding": OP10_SQL}
