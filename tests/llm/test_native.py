"""Token rollup, URL filter, sharding, mixing and exact top-k against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from treeweave.llm import mixing, sharding, token_rollup, topk, url_filter
from treeweave.llm.common import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


def test_rollup(spark):
    rows = [(1, "a b  c", "en", "s", 6), (2, None, None, "s", 0), (3, "", "en", None, 0), (3, "x\ty", "en", None, 3), (3, "x\ty", "en", None, 3)]
    work = Workspace(spark, "t")
    counts = work.write(docs(spark, rows).select("*", *[f(F.col("text")).alias(n) for n, f in token_rollup.TOKENIZERS.items()]), "c")
    r = token_rollup.TokenRollup(spark, f"{work.path}/r")
    assert r.totals().count() == 0
    first = token_rollup.inserts(counts, "words@1", "words@1")
    assert r.commit("b1", first) and not r.commit("b1", first)
    bag = lambda: {(x.source, x.lang): (x.docs, x.tokens) for x in r.totals().collect()}
    assert bag() == {("s", "en"): (1, 3), ("s", None): (1, 0), (None, "en"): (3, 4)}
    r.commit("b2", token_rollup.revisions(counts, "words@1", "words@1", "n_chars"))
    r.commit("b3", token_rollup.deletes(counts.filter("doc_id = 1"), "words@1", "n_chars"))
    r.commit("empty", token_rollup.inserts(counts.limit(0), "words@1", "words@1"))
    after = bag()
    assert after == {("s", None): (1, 0), (None, "en"): (3, 6)}
    r.compact()
    assert bag() == after and r.batches() == ["b1", "b2", "b3", "empty"] and not r.commit("b2", first) and r.commit("b4", first)
    with pytest.raises(ValueError):
        r.commit("+x", first)
    assert [x.n_tokens for x in token_rollup.bpe_counts(docs(spark, rows).filter("doc_id < 3")).orderBy("doc_id").collect()] == [4, 0]


def test_compaction_that_is_interrupted(spark, monkeypatch):
    work = Workspace(spark, "t")
    r = token_rollup.TokenRollup(spark, f"{work.path}/r")
    counts = docs(spark, [(1, "a b", "en", "s", 2), (2, "c", "en", "s", 1)])
    r.commit("b1", token_rollup.inserts(counts, "words@1", "n_chars"))
    r.commit("b2", token_rollup.inserts(counts, "words@1", "n_chars"))
    state = lambda: ([tuple(x) for x in r.totals().collect()], r.batches())
    before = state()
    with monkeypatch.context() as m:
        m.setattr(token_rollup.TokenRollup, "_rename", lambda self, a, b: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            r.compact()
        with pytest.raises(OSError):
            r.commit("b3", token_rollup.inserts(counts, "words@1", "n_chars"))
    assert state() == before == ([("s", "en", "words@1", 4, 6)], ["b1", "b2"])
    fs = r._fs

    class Stuck:
        def __getattr__(self, name):
            return getattr(fs, name)

        def delete(self, path, deep):
            if "batch-" in path.getName():
                raise OSError("lost")
            return fs.delete(path, deep)

    r._fs = Stuck()
    with pytest.raises(OSError):
        r.compact()
    r._fs = fs
    assert state() == before and not r.commit("b1", token_rollup.inserts(counts, "words@1", "n_chars"))
    r.compact()
    assert state() == before and [n for n in (p.getPath().getName() for p in fs.listStatus(r._at("."))) if n.startswith("batch")] == ["batch-+2"]


def judge(url, rules, default):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, default))
    return host, path, rule, verdict


def test_urls(spark):
    r = random.Random(1)
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.b.net", "", "allow"), ("b.net", "/x", "block")] + [(f"h{i}.org", f"/p{i % 7}", "block") for i in range(300)]
    urls = [None, "", "no scheme", "http://", "http://COM/", "https://Example.com/en/?q", "https://www.example.com/en/x#y", "http://x.example.com/en", "ftp://é.NET/es/1", "http://a.b.net", "http://c.a.b.net?x", "http://b.net/xyz", "http://com?/", "a://b://c/d", "http://h3.org/p3z", "http://k.h3.org/p4", "http://example.com/en/\n"]
    urls += [f"http://h{r.randrange(400)}.org/p{r.randrange(9)}" for _ in range(300)] + ["http://h5.org/p5"] * 50
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    out = url_filter.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in out.collect()}
    assert got == {i: judge(u, rules, "allow") for i, u in enumerate(urls)}
    assert url_filter.filter_urls(pages, spark.createDataFrame([], "host string, path string, verdict string"), default="block").filter("verdict = 'block' AND rule IS NULL").count() == len(urls)
    assert url_filter.filter_urls(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_urls_of_like_rules(spark):
    """A rule is a host and a path, not their concatenation; equally long rules; columns with the names used inside."""
    listed = spark.createDataFrame([("a.b", "c.net", "block"), ("x.y", "", "allow"), ("org", "/abcd", "block"), ("abc.org", "/", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.bc.net", 5, 6, 7), (2, "http://abc.org/abcd", 5, 6, 7), (3, None, 5, 6, 7)], "_rule long, url string, _h long, _p long, _verdict long")
    got = {x["_rule"]: (x.rule, x.verdict, x["_h"], x["_verdict"]) for x in url_filter.filter_urls(pages, listed).collect()}
    assert got == {1: (None, "allow", 5, 7), 2: ("abc.org/", "allow", 5, 7), 3: (None, "allow", 5, 7)}


def test_bloom_loses_nothing_and_passes_little(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = keys.limit(2000)
    bloom, blocks = url_filter.build_filter(listed, 2000)
    assert url_filter.probe(listed, bloom, blocks).count() == 2000
    assert url_filter.probe(spark.range(5000, 9000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key")), bloom, blocks).count() < 100


def bits(key, n=60):
    return bin(int(hashlib.md5(key.encode()).hexdigest()[:15], 16))[2:].zfill(60)


def test_shards(spark):
    r = random.Random(2)
    rows = [(i, "x" * r.randrange(200)) for i in range(400)] + [(7, "y" * 50)] * 60 + [(None, None), (5000, "z" * 3000), (None, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    limit = 1000
    out = sharding.assign_shards(df, limit).collect()
    size = lambda t: len((t or "").encode())
    assert Counter((x.doc_id, x.n_bytes) for x in out) == Counter((i, size(t)) for i, t in rows)
    held = defaultdict(list)
    for x in out:
        held[x.shard].append(x.n_bytes)
        assert len(x.shard) == x.depth and (x.depth > 60 or bits("" if x.doc_id is None else str(x.doc_id)).startswith(x.shard))
    assert all(sum(v) <= limit or len(v) == 1 for v in held.values())
    assert not any(a != b and b.startswith(a) for a in held for b in held)  # the shards' prefixes part the hashes
    whole = [(bits("" if i is None else str(i)), size(t)) for i, t in rows]
    for s in held:
        if 0 < len(s) <= 60:  # the parent was too large
            parent = [n for b, n in whole if b.startswith(s[:-1])]
            assert sum(parent) > limit and len(parent) > 1
    assert sharding.assign_shards(df.limit(0), limit).count() == 0
    assert {x.shard for x in sharding.assign_shards(df, 10**9).collect()} == {""}


def test_directory_beyond_a_broadcast(spark, monkeypatch):
    r = random.Random(8)
    df = spark.createDataFrame([(r.randrange(300), "x" * r.randrange(100)) for _ in range(900)], "doc_id long, text string")
    small = sorted(map(tuple, sharding.assign_shards(df.filter("doc_id < 250"), 700).groupBy("doc_id", "n_bytes").count().collect()))
    few = sorted(tuple(x) for x in sharding.assign_shards(df.dropDuplicates(["doc_id"]), 200).collect())
    monkeypatch.setattr(sharding, "CELLS", 0)
    assert sorted(map(tuple, sharding.assign_shards(df.filter("doc_id < 250"), 700).groupBy("doc_id", "n_bytes").count().collect())) == small
    assert {x[0] for x in few} == {x.doc_id for x in sharding.assign_shards(df.dropDuplicates(["doc_id"]), 200).collect()}


def test_written_shards(spark, tmp_path):
    rows = [(None, "n", 0), (7, "x" * 900, 1), (7, "x" * 900, 2), (8, "y" * 500, 3), (None, None, 4), (9, "é" * 400, 5)] + [(i, "z" * 90, i) for i in range(20, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    shards = sharding.write_shards(df, f"{tmp_path}/out", 1000)
    assert shards.columns == ["doc_id", "n_bytes", "depth", "shard"]
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert Counter((x.doc_id, x.text, x.shard) for x in out) == Counter(rows)
    held = defaultdict(list)
    for x in out:
        held[x.shard_].append((x.doc_id, len((x.text or "").encode())))
    assert {(k[1:], i) for k, v in held.items() for i, _ in v} == {(x.shard, x.doc_id) for x in shards.collect()}
    assert all(sum(n for _, n in v) <= 1000 or len(v) == 1 for v in held.values()) and len(held) > 5
    assert sharding.assign_shards(df.limit(0), 10).count() == 0


def fill(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, total, out = set(names), share * sum(sizes.values()), {}
    while left:
        over = {s for s in left if total * w[s] / sum(w[x] for x in left) > most * sizes[s] + 1e-9}
        if not over:
            return out | {s: total * w[s] / sum(w[x] for x in left) for s in left}
        for s in over:
            out[s] = most * sizes[s]
        total -= sum(out[s] for s in over)
        left -= over
    return out


@pytest.mark.parametrize("chunk", [20_000, 50])
def test_mix(spark, chunk):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randrange(1, 60)), "en", r.choice(["a", "a", "a", "b", "Z", "é", None]), 0) for i in range(500)] + [(900, None, "en", "b", 0), (901, " \n", "en", "empty", 0)] + [(1, "one two", "en", "a", 0)] * 5
    df = docs(spark, rows)
    run = lambda: mixing.mix(df, [3.0, 1.0, 2.0], chunk=chunk).collect()
    out = run()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    expected, taken = fill(sizes, [3.0, 1.0, 2.0], 1.5, 2.0), Counter()
    assert Counter((x.doc_id, x.size) for x in out) == Counter((i, len(WORD.findall(t or ""))) for i, t, *_ in rows)
    for x in out:
        assert x.target == pytest.approx(expected[x.source]) and x.source_size == sizes[x.source] and x.taken == x.times * x.size <= 2 * x.size
        taken[x.source] += x.taken
    assert all(abs(taken[s] - expected[s]) <= max(3, 0.01 * expected[s]) for s in expected)
    assert Counter((x.doc_id, x.taken) for x in out) == Counter((x.doc_id, x.taken) for x in run())
    copies = mixing.mixed_documents(df, [3.0, 1.0, 2.0])
    assert copies.columns == df.columns
    words = Counter()
    for x in copies.collect():
        words[x.source] += len(WORD.findall(x.text or ""))
    assert all(abs(words[s] - expected[s]) <= max(3, 0.01 * expected[s]) for s in expected)
    assert mixing.mix(df.limit(0), [1.0]).count() == 0 == mixing.mixed_documents(df.limit(0), [1.0]).count()


def test_mix_is_the_same_for_other_splits(spark):
    """Repeated rows beyond a chunk, other partitions, and columns with the names used inside."""
    r = random.Random(6)
    rows = [(i, " ".join(["w"] * r.randrange(1, 60)), "a", i, 0, 0, 0) for i in range(300)] + [(1, "one two three", "a", 0, 0, 0, 0)] * 200 + [(2, "one two", "b", 0, 0, 0, 0)] * 30
    schema = "doc_id long, text string, source string, _order long, _times long, _rows long, _id long"
    bags = []
    for n in (1, 7):
        df = spark.createDataFrame(r.sample(rows, len(rows)), schema).repartition(n)
        mixing.COPIES, old = 64, mixing.COPIES
        out = mixing.mix(df.select("doc_id", "text", "source"), [3.0, 1.0], chunk=40).collect()
        mixing.COPIES = old
        assert len(out) == len(rows)
        copies = mixing.mixed_documents(df, [3.0, 1.0])
        assert copies.columns == df.columns and all(x["_order"] == x.doc_id or x.doc_id in (1, 2) for x in copies.collect())
        bags.append((Counter((x.doc_id, x.size, x.taken) for x in out), Counter(x.doc_id for x in copies.collect())))
    assert bags[0] == bags[1]


def test_flight_keeps_sums():
    r = random.Random(4)
    sizes = [r.randrange(1, 400) for _ in range(300)]
    p = [r.random() for _ in sizes]
    before = sum(p), sum(a * b for a, b in zip(sizes, p))
    left = mixing.flight(sizes, p, 9)
    assert len(left) <= 2 and sum(p) == pytest.approx(before[0]) and sum(a * b for a, b in zip(sizes, p)) == pytest.approx(before[1])


@pytest.mark.parametrize("block", [32_768, 3])
def test_topk(spark, block):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(20)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(30)] + [(1000, None), (1001, []), (1002, [float("nan")] * 20), (1003, [1.0] * 3), (1004, [None] * 20), (None, rows[0][1]), (20, rows[3][1]), (1100, [float("inf")] + [0.0] * 19), (1200, [0.0] * 20)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    import numpy as np

    kept = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v and len(v) == 20 and None not in v and np.isfinite(v).all()]
    expected = {}
    asked = {}
    for i, q in kept:
        if i % 10 == 0 and (i not in asked or tuple(q) < tuple(asked[i])):
            asked[i] = q
    for i, q in asked.items():
        best = sorted((-int(q @ x), j) for j, x in kept if j != i)[:10]
        expected |= {(i, k + 1): (j, -s) for k, (s, j) in enumerate(best)}
    got = topk.exact_topk(df, F.col("vec_id") % 10 == 0, 10, query_block=block, cell=32_768 if block > 3 else 50)
    assert {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in got.collect()} == expected
    assert topk.exact_topk(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_topk_of_long_vectors(spark):
    rows = [(0, [70000.0, 70000.0]), (1, [70000.0, 70000.0]), (2, [3e6, -1.0]), (3, [-3e6, 1e-9]), (4, [0.25, 2.0**25]), (100, [0.5, -0.001]), (5, [1e5, 1e5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    grid = {i: [topk.floor(topk.Fraction(x) * 1024) for x in v] for i, v in rows}
    for asked in (0, 100):
        got = [(x.vec_id, x.score) for x in topk.exact_topk(df, F.col("vec_id") == asked, 3).orderBy("rank").collect()]
        want = sorted((-sum(a * b for a, b in zip(grid[asked], v)), i) for i, v in grid.items() if i != asked)[:3]
        assert got == [(i, -s) for s, i in want]
    assert (1, 10_276_044_800_000_000) in [(x.vec_id, x.score) for x in topk.exact_topk(df, F.col("vec_id") == 0, 9).collect()]
    with pytest.raises(Exception, match="64 bits"):
        topk.exact_topk(df.filter("vec_id <> 5").union(spark.createDataFrame([(6, [0.0, 2.0**60])], df.schema)), F.col("vec_id") == 4, 3).collect()
