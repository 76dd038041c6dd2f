"""From raw documents to packed training sequences: reject toxic documents, keep one of each near-duplicate group, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of documents.

Defined cases: null or empty texts are clean, are no duplicates, take part in no mix (size 0) and so end there; rows
without a doc_id are never duplicates; rows that repeat a doc_id are duplicates, of which the one with the greatest text stays; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeweave.llm import mixing, ngram_join, packing, toxicity
from treeweave.llm.common import Workspace, small, table
from treeweave.llm.queries import WEIGHTS, held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The lexicon is learned from the labelled documents among docs, as in op6; those scored 0.5 or more go."""
    lexicon = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), ~held_out())
    name = "toxicity"
    while name in docs.columns:
        name += "_"
    return toxicity.score(docs, lexicon, name).filter(F.col(name) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents, the one with the smallest doc_id stays."""
    found = Workspace(spark, "near-duplicates")
    groups = found.write(ngram_join.link_components(docs.select("doc_id", "text")), "groups")
    others = groups.filter("component_id <> doc_id").select("doc_id").distinct()
    n = others.count()
    kept = docs.join(small(others, n), "doc_id", "left_anti")
    # ids that several rows carry: of each the row with the greatest text, then the greatest other columns, stays
    repeated = groups.filter("doc_id IS NOT NULL AND component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id")
    n = repeated.count()
    if n:
        row = F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
        once = kept.join(small(repeated, n), "doc_id", "left_semi").groupBy("doc_id").agg(F.max(row).alias("row")).select("doc_id", "row.*")
        kept = kept.join(small(repeated, n), "doc_id", "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs, WEIGHTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("mix", mix_sources), ("pack", pack_sequences)]

#: SQL can't express these stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
