"""The registered queries: those with SQL against DuckDB, the others against plain Python, on the smallest tables."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from treeweave.llm import queries

FOLDER = "/root/testdata/sf0.001"


def table(name, *columns):
    return pq.read_table(f"{FOLDER}/{name}.parquet", columns=list(columns)).to_pylist()


def plain(rows):
    return sorted([str(x) for x in r] for r in rows)


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, FOLDER), db.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert plain(df.select(*columns).collect()) == plain(want.select(*columns).fetchall())


@pytest.fixture(scope="module")
def ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {d["doc_id"]: t.encode(d["text"] or "", add_special_tokens=False).ids for d in table("documents", "doc_id", "text")}


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_op5(spark, ids):
    want, held = Counter(), defaultdict(list)
    for i, x in ids.items():
        x = [*x, 0]
        first = len(x) % 2048 or 2048
        cuts = [0, *range(first, len(x), 2048)]
        want.update((i, k, s, len(p), crc(p)) for k, (s, p) in enumerate((s, x[s : first if s == 0 else s + 2048]) for s in cuts))
    got = queries.QUERIES["op5_best_fit_packing"](spark, FOLDER).collect()
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    for x in got:
        held[x.sequence_id].append((x.offset, x.length))
    for v in held.values():
        assert [o for o, _ in sorted(v)] == np.cumsum([0, *(n for _, n in sorted(v))])[:-1].tolist() and sum(n for _, n in v) <= 2048
    assert len(held) <= -(-sum(x.length for x in got) // 2048) + 1


def test_op6(spark):
    labels = {x["doc_id"]: x["toxic"] for x in table("labels", "doc_id", "toxic")}
    got = queries.QUERIES["op6_toxicity"](spark, FOLDER).collect()
    assert sorted(x.doc_id for x in got) == sorted(x["doc_id"] for x in table("documents", "doc_id"))
    for x in got:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.5)
    held = [(x.predicted, labels[x.doc_id]) for x in got if x.held_out and labels.get(x.doc_id) is not None]
    assert sum(p == y for p, y in held) >= 0.85 * len(held)


def test_op7(spark):
    import re

    from .test_native import fill

    size = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in table("documents", "doc_id", "text")}
    source = {d["doc_id"]: d["source"] for d in table("documents", "doc_id", "source")}
    sums, taken = Counter(), Counter()
    for i, s in source.items():
        sums[s] += size[i]
    targets = fill(sums, queries.WEIGHTS, 1.5, 2.0)
    got = queries.QUERIES["op7_mixing"](spark, FOLDER).collect()
    assert sorted(x.doc_id for x in got) == sorted(size)
    for x in got:
        s = source[x.doc_id]
        assert x.size == size[x.doc_id] and x.source_size == sums[s] and x.target == pytest.approx(targets[s]) and x.taken <= 2 * x.size and (not x.size or x.taken % x.size == 0)
        taken[s] += x.taken
    assert all(abs(taken[s] - targets[s]) <= max(3, 0.01 * targets[s]) for s in targets)


def test_op8(spark, ids):
    got = sorted(queries.QUERIES["op8_token_files"](spark, FOLDER).collect(), key=lambda x: x.start)
    at = 0
    for i, x in zip(sorted(ids), got, strict=True):
        whole = [*ids[i], 2]
        assert (x.doc_id, x.start, x.n_tokens, x.ids_crc32) == (i, at, len(whole), crc(whole))
        at += len(whole)


def test_op4(spark):
    from .test_text import brute_components

    rows = [(d["doc_id"], d["text"]) for d in table("documents", "doc_id", "text")]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in queries.QUERIES["op4_ngram_join"](spark, FOLDER).collect()}
    assert got == brute_components(rows)
