"""Tokenizing, packing, token files, n-gram join, toxicity, nearest neighbours and the pipeline against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeweave.llm import ann, components, ngram_join, packing, token_files, toxicity
from treeweave.llm.common import Workspace, codec

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["a  b", " a", "a ", "a \n b", "x\n\n y  z \n", "<|endoftext|> hi", "a<|endoftext|><|endoftext|> b <|endoftext|>\nc <|endoftext", "a\n\nb\nc \nd\n e", "x.\nY,\n", "no\n1\n's", "it's don't 's  're", "ünï çø \u3000 x\xa0y z\x1c a", "", "\t\t", "a\u180e b  c", "日本語 text\u2028more \U0001f600 ok", "x" * 3000, None]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def words(r, n):
    return " ".join(r.choice(["alpha", "beta,", "Gamma.", "δelta", "x1", "of", "the", f"w{r.randrange(10**6)}"]) for _ in range(n))


def test_codec(library, monkeypatch):
    from treeweave.llm import common

    r = random.Random(1)
    odd = "".join
    some = ["<|endoftext|>", "<|endof", "text|>", "\n", " ", "  ", "a", "é", "foo", "Bar.", "'s", "12", "!?", "\u3000", "\xa0", "\u180e", "日本", "ɐx", "\t", "\x1c", "\r\n", "İ", "x\u0301", "\x00"]
    monkeypatch.setattr(common, "LIMIT", 50)  # so that words leave the cache and come back
    for t in ODD + [words(r, 200) for _ in range(20)] + [odd(r.choice(some) for _ in range(r.randrange(1, 12))) for _ in range(2000)]:
        assert np.frombuffer(codec().encode(t), "<u2").tolist() == library(t)


def test_packing(spark, library):
    r = random.Random(2)
    rows = [(i, words(r, r.choice([1, 5, 40, 300]))) for i in range(150)] + [(500, words(r, 4000)), (501, None), (501, ""), (None, "a b")] + [(7, "same text")] * 3
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, piece int")
    for bins in (4096, 1):
        out = packing.pack(packing.pieces(df), bins=bins).collect()
        ids = lambda t: library(t) + [0]
        want = Counter()
        for i, t in rows:
            for k, (s, n) in enumerate(packing.cut(len(ids(t)), 2048)):
                want[i, k, s, n, zlib.crc32(np.array(ids(t)[s : s + n], "<u4").tobytes())] += 1
        assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in out) == want
        held = defaultdict(list)
        for x in out:
            held[x.sequence_id].append((x.offset, x.length))
        for v in held.values():
            at = 0
            for o, n in sorted(v):
                assert o == at
                at += n
            assert at <= 2048
        assert len(held) <= -(-sum(x.length for x in out) // 2048) + 1
    assert packing.pack_documents(df.limit(0)).count() == 0
    assert packing.cut(4097, 2048) == [(0, 1), (1, 2048), (2049, 2048)]


def test_packing_bounds_rows(spark):
    """A task packs a bounded number of pieces, however short they are; all are there once, without gaps."""
    df = spark.createDataFrame([(i, None if i % 2 else "a b") for i in range(1500)], "doc_id long, text string")
    out = packing.pack(packing.pieces(df), most=200).collect()
    assert Counter((x.doc_id, x.length) for x in out) == Counter((i, 1 if i % 2 else 3) for i in range(1500))
    held = defaultdict(list)
    for x in out:
        held[x.sequence_id].append((x.offset, x.length))
    for v in held.values():
        assert [o for o, _ in sorted(v)] == np.cumsum([0, *(n for _, n in sorted(v))])[:-1].tolist() and sum(n for _, n in v) <= 2048
    assert max(map(len, held.values())) <= 400 and len(held) <= 8


def test_bounds_are_bounds():
    r = random.Random(3)
    for _ in range(60):
        lengths = sorted((r.choice([r.randrange(1, 21), 10, 11, 7]) for _ in range(r.randrange(1, 9))), reverse=True)
        bins, offsets, fill = packing.best_fit(lengths, 20)
        bound = packing.lower_bound(np.bincount(lengths, minlength=21), 20)

        def least(i, open_):
            if i == len(lengths):
                return len(open_)
            tries = [least(i + 1, open_[:k] + [open_[k] + lengths[i]] + open_[k + 1 :]) for k in range(len(open_)) if open_[k] + lengths[i] <= 20 and open_[k] not in open_[:k]]
            return min([*tries, least(i + 1, open_ + [lengths[i]])])

        assert bound <= least(0, []) <= len(fill) and max(fill) <= 20


def test_token_files(spark, library):
    r = random.Random(4)
    phrase = words(r, 30)
    rows = [(1000 - i, (phrase + " " + words(r, 20)) * r.randrange(1, 6)) for i in range(120)] + [(None, "n"), (3, None), (3, ""), (4, "twice"), (4, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = f"{Workspace(spark, 'tf').path}/f"
    token_files.write_token_files(df, path, shard_ids=3000, shards=3)
    got = token_files.document_digests(spark, path).collect()
    ids = lambda t: library(t) + [2]
    assert Counter((x.doc_id, x.n_tokens, x.ids_crc32) for x in got) == Counter((i, len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for i, t in rows)
    at = 0
    for x in sorted(got, key=lambda x: x.start):
        assert x.start == at
        at += x.n_tokens
    order = [x.doc_id for x in sorted(got, key=lambda x: x.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert token_files.read_document(spark, path, 950) == [ids(dict(rows)[950])] and len(token_files.read_document(spark, path, 4)) == 2
    assert token_files.read_document(spark, path, -5) == []
    shards = token_files.read_token_files(spark, path).collect()
    for x in shards:
        held = [i for i, null in zip(np.frombuffer(x.doc_ids, "<i8").tolist(), x.id_nulls) if not null]
        assert (x.first_id, x.last_id) == ((held[0], held[-1]) if held else (None, None))
    assert len(shards) > 3 and sum(len(s.symbols) // 2 for s in shards) < at
    token_files.write_token_files(df.limit(0), path)
    assert token_files.document_digests(spark, path).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_repair_round_trip(seed):
    r = np.random.default_rng(seed)
    ids = r.choice([1, 1, 1, 2, 3], 5000) if seed else np.full(5000, 9)
    seq, rules, lengths = token_files.repair(ids, 50, min_count=4, top=64)
    assert len(seq) < len(ids) and len(rules)
    left = Counter(zip(seq[:-1].tolist(), seq[1:].tolist()))
    assert max(n for (a, b), n in left.items() if a != b) < 4 and max([n for (a, b), n in left.items() if a == b], default=0) < 4
    marks = np.concatenate([[0], np.cumsum(np.concatenate([np.ones(50, np.uint64), lengths])[seq])]).astype("<u8")[:-1 : token_files.MARK]
    shard = token_files.Shard(50, rules.tobytes(), lengths.tobytes(), seq.tobytes(), marks.tobytes())
    assert (shard.ids() == ids).all() and (shard.slice(1234, 2345) == ids[1234:2345]).all() and len(shard.slice(7, 7)) == 0


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=90):
    r = random.Random(seed)
    bases = [[f"w{r.randrange(300)}" for _ in range(r.choice([3, 5, 6, 20, 60, 120]))] for _ in range(12)]
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        if r.random() < 0.2:
            w = w + passage
        rows.append((i * 3 + 1, " ".join(w).upper() if r.random() < 0.1 else " ".join(w)))
    return rows + [(2, None), (5, ""), (8, " \n\t"), (11, "one two"), (14, "One  two"), (17, "ONE\x1ftwo")]


@pytest.mark.parametrize("seed,cell,entries", [(1, 1000, 8000), (2, 4, 8000), (1, 1000, 20)])
def test_ngram_join(spark, seed, cell, entries, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", cell)
    monkeypatch.setattr(ngram_join, "ENTRIES", entries)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n long, h string").repartition(5)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.link_components(df).collect()}
    assert got == brute_components(rows)


def test_word_hashes():
    """Equal for equal words only: words of all lengths, words that differ in one byte, and the two that polynomials modulo 2**64 can't tell apart."""
    import pyarrow as pa

    from treeweave.llm.shingles import _word_hashes

    r = random.Random(9)
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    some = {thue, thue.translate(str.maketrans("ab", "ba")), *("x" * n for n in range(1, 600)), *("é" * n + "y" for n in range(140))}
    for n in (1, 7, 8, 9, 16, 63, 255, 256, 257, 4000):
        w = "".join(r.choice("abc") for _ in range(n))
        some |= {w[:k] + "z" + w[k + 1 :] for k in range(0, n, max(1, n // 20))} | {w}
    some = sorted(some)
    got = _word_hashes(pa.array(some))
    assert len(set(got.tolist())) == len(some)
    assert _word_hashes(pa.array(["pad", *some]).slice(1)).tolist() == got.tolist() == _word_hashes(pa.array(some, pa.large_string())).tolist()
    assert len(_word_hashes(pa.array([], pa.string()))) == 0


def test_ngram_join_of_one_shingle(spark):
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = thue.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{thue} x"), (2, f"{other} x"), (3, f"x {thue}"), (4, f" X\t{thue} "), (5, "q q q q q"), (6, "q " * 40), (7, "q q q q"), (8, "Q q q q"), (9, " ".join(f"{thue} {i}" for i in range(30))), (10, " ".join(f"{other} {i}" for i in range(30)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.link_components(df).collect()}
    assert got == brute_components(rows) and got[6] == (1, 5) and got[8] == (1, 7) and got[10][1] == 10


def test_ngram_join_edge_cases(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (9, "a b c d e f"), (4, "z")], "doc_id long, text string")
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.link_components(df).collect())
    assert got == {(1, 2, 1): 2, (None, 0, None): 1, (9, 2, 1): 1, (4, 1, 4): 1}
    assert ngram_join.link_components(df.limit(0)).count() == 0


def test_ngram_join_texts_of_one_id(spark):
    r = random.Random(5)
    long, short, other = words(r, 40), words(r, 20), words(r, 30)
    last = 2**63 - 1
    rows = [(7, long), (7, short), (7, None), (3, short), (last, long), (5, other), (5, None), (8, other), (6, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sizes, got = {}, {}
    for x in ngram_join.link_components(df).collect():
        assert got.setdefault(x.doc_id, x.component_id) == x.component_id
        sizes[x.doc_id] = x.n_shingles
    assert got == {7: 3, 3: 3, last: 3, 5: 5, 8: 5, 6: 6}
    n = {t: brute_components([(1, t)])[1][0] for t in (long, short, other)}
    assert sizes == {7: n[long], 3: n[short], last: n[long], 5: n[other], 8: n[other], 6: 0}


def test_pipeline_keeps_a_fixed_row(spark):
    import corpus_pipeline as p

    rows = [(1, "a b c d e f", "x"), (1, "q r s t u v", "y"), (1, None, "z"), (2, "k l m n o p", "x")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, source string").coalesce(1)
        assert sorted(tuple(x) for x in p.drop_near_duplicates(spark, df, "").collect()) == [rows[1], rows[3]]


def test_components(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "cc")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_folding():
    assert toxicity.fold("You ІDІ0T!!") == " you idiot " and toxicity.fold("st\u200bup1d, l0ser.") == " stupid loser "
    assert toxicity.fold("ｍｏｒｏｎ") == " moron " and toxicity.fold("in 2024, 10 b$") == " in 2024 10 b " and toxicity.fold(None) == " "


def test_toxicity(spark):
    r = random.Random(7)
    bad, plain_words = ["vilest", "grubby", "moronic"], [f"n{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(1200):
        w = [r.choice(plain_words) for _ in range(r.randrange(10, 120))]
        toxic = i % 6 == 0
        for _ in range(r.randrange(2, 5) if toxic else 0):
            x = r.choice(bad) if i % 12 else "krump" + r.choice(["ab", "cd", "ef", "gh", "ij"])
            w.insert(r.randrange(len(w)), x.replace("o", "0") if r.random() < 0.2 and x == "moronic" else x)
        if not toxic and r.random() < 0.1:
            w.insert(1, "not grubby")
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic), 1))
    df, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(5, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    lexicon = toxicity.fit(df, y, F.col("doc_id") % 5 > 0)
    assert any(e.startswith(" krump") for e in lexicon.entries)
    extra = df.unionByName(spark.createDataFrame([(9000, None), (9001, ""), (None, "moronic vilest")], "doc_id long, text string"))
    got = toxicity.score(extra, lexicon)
    assert got.columns == ["doc_id", "text", "score"] and got.count() == 1203
    scores = {x.doc_id: x.score for x in got.collect()}
    held = [i for i in range(0, 1200, 5)]
    right = sum((scores[i] >= 0.5) == (i % 6 == 0) for i in held)
    assert right >= 0.95 * len(held) and scores[9000] == scores[9001] < 0.5 < scores[None]
    assert toxicity.fit(df, y.filter("toxic = 0")).entries == {} and toxicity.score(df.limit(0), lexicon).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_lexicon_against_plain_search(seed):
    """The automaton finds what a search of every entry at every place finds; hits in an exception phrase don't count."""
    r = random.Random(seed)
    letters = "abc"
    word = lambda: "".join(r.choice(letters) for _ in range(r.randrange(1, 5)))
    entries = {f" {word()}{r.choice([' ', ''])}": r.random() for _ in range(12)}
    exceptions = {f" {word()} {word()} " for _ in range(12)} - entries.keys()
    lexicon = toxicity.Lexicon(entries, exceptions, -1.0, (0.5, 0.25))
    automaton = lexicon.automaton()
    for _ in range(200):
        text = " ".join(word() for _ in range(r.randrange(0, 40)))
        folded = toxicity.fold(text)
        find = lambda phrase: [k for k in range(len(folded)) if folded.startswith(phrase, k)]
        harmless = {k + i for p in exceptions for k in find(p) for i, c in enumerate(p[:-1]) if c == " "}
        hits = [w for e, w in entries.items() for k in find(e) if k not in harmless]
        total, by_length, n = lexicon.features(automaton, text)
        words_in = len(folded.split())
        assert n == len(hits) and total == pytest.approx(sum(hits)) and by_length == pytest.approx(sum(hits) / (words_in + 20) * 1000)
    assert toxicity.Lexicon().features(toxicity.Lexicon().automaton(), "a b")[2] == 0


def test_toxicity_of_repeated_rows_and_other_columns(spark):
    lexicon = toxicity.Lexicon({" bad ": 2.0}, set(), -1.0, (1.0, 1.0))
    df = spark.createDataFrame([(1, "bad " * 50_000, 9), (1, "bad " * 50_000, 9), (2, None, 9), (None, "fine", 9)], "doc_id long, text string, score int")
    got = toxicity.score(df, lexicon).collect()
    assert len(got) == 4 and sorted(x.score >= 0.5 for x in got) == [False, False, True, True]
    assert toxicity.score(df, lexicon, "other").columns == ["doc_id", "text", "score", "other"]


def test_toxicity_exceptions(spark):
    r = random.Random(11)
    rows, labels = [], []
    for i in range(1050):
        w = [f"n{r.randrange(2000)}" for _ in range(r.randrange(30, 60))]
        toxic = i % 7 == 0  # 150 of 1050
        # 149 toxic and 40 clean documents have the entry; "so grubby" is in 4 clean and 1 toxic, so more often in a toxic one
        use = ("grubby" if i else "so grubby") if toxic else "not grubby hands" if i % 25 == 1 else "so grubby" if i in (3, 10, 17, 24) else None
        if use:
            w.insert(r.randrange(5, 25), use)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    lexicon = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    automaton = lexicon.automaton()
    hits = lambda t: lexicon.features(automaton, t)[2]
    assert {" not grubby ", " grubby hands "} <= set(lexicon.exceptions) and hits("a grubby b") == 1 and hits("not grubby hands") == 0
    assert (hits("not grubby hands and a grubby one"), " so grubby " in lexicon.exceptions) == (1, False)


def test_nearest_neighbours(spark):
    r = np.random.default_rng(8)
    centres = r.standard_normal((8, 16)) * 3
    x = (centres[r.integers(0, 8, 1500)] + r.standard_normal((1500, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, []), (5040, [0.0] * 16), (5060, [float("nan")] * 16), (5080, [1.0]), (None, x[0].tolist())] + [(2000 + i, x[3].tolist()) for i in range(40)]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double")
    kept = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 16 and np.isfinite(v).all() and any(v)]
    m, ids = np.stack([v for _, v in kept]), np.array([i for i, _ in kept])
    got = ann.search(df, F.col("vec_id") % 20 == 0, 20).collect()
    by = defaultdict(list)
    for g in sorted(got, key=lambda g: g["rank"]):
        by[g.query_id].append((g.vec_id, g.score))
    hits = total = 0
    asked = [i for i in ids if i % 20 == 0]
    assert set(by) == set(asked)
    for q in asked:
        s = m @ m[np.flatnonzero(ids == q)[0]]
        true = [ids[j] for j in sorted(np.flatnonzero(ids != q), key=lambda j: (-s[j], ids[j]))[:20]]
        hits, total = hits + len({a for a, _ in by[q]} & set(true)), total + 20
        assert [a for a, _ in by[q]] == [a for a, _ in sorted(by[q], key=lambda p: (-p[1], p[0]))] and len(by[q]) == 20
        assert all(abs(v - s[np.flatnonzero(ids == a)[0]]) < 1e-9 for a, v in by[q])
    assert hits >= 0.9 * total
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    again = ann.search(df.repartition(3), F.col("vec_id") % 20 == 0, 20).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    few = ann.search(df.filter("vec_id IN (0, 1, 2)"), F.col("vec_id") % 20 == 0).collect()
    assert [(g.query_id, g["rank"]) for g in sorted(few, key=lambda g: g["rank"])] == [(0, 1), (0, 2)]


def test_nearest_neighbours_of_lone_vectors(spark):
    """Tight groups and a few vectors apart: every query gets k rows, though few lists are probed; one vector that a third of the rows have; small cells."""
    r = np.random.default_rng(9)
    centres = r.standard_normal((60, 16)) * 5
    x = np.concatenate([np.repeat(centres, 21, 0) + 0.01 * r.standard_normal((1260, 16)), r.standard_normal((15, 16)) * 5, np.repeat(centres[:1] + 1, 600, 0)])
    rows = [(int(i) * 5, v.tolist(), "z") for i, v in zip(r.permutation(len(x)), x)] + [(100, x[0].tolist(), "z")] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string")
    m, ids = np.array([v for _, v, _ in rows]), np.array([i for i, _, _ in rows])
    for cell in (ann.CELL, 50):
        ann.CELL, old, ann.QUERIES = cell, ann.CELL, 4096 if cell > 50 else 40
        hits = total = 0
        by = defaultdict(list)
        for g in sorted(ann.search(df, F.col("vec_id") % 20 == 0, 20).collect(), key=lambda g: g["rank"]):
            by[g.query_id].append((g.vec_id, g.score))
        ann.CELL, ann.QUERIES = old, 4096
        assert set(by) == {i for i in ids.tolist() if i % 20 == 0} and all(len(v) == 20 for v in by.values())
        for q, found in by.items():
            mine = min((m[j].tolist() for j in np.flatnonzero(ids == q)))
            s = (m * np.array(mine)).sum(1)
            true = sorted(zip(-s[ids != q], ids[ids != q]))[:20]
            hits, total = hits + sum((Counter((i, round(-v, 9)) for v, i in true) & Counter((i, round(v, 9)) for i, v in found)).values()), total + 20
        assert hits >= 0.9 * total


def test_recall_on_the_given_embeddings(spark):
    import pyarrow.parquet as pq

    from treeweave.llm import queries

    t = pq.read_table("/root/testdata/sf0.01/embeddings.parquet", columns=["vec_id", "embedding"])
    ids, m = np.array(t.column("vec_id")), np.array(t.column("embedding").to_pylist(), float)
    found = defaultdict(set)
    for g in queries.op3_nearest_neighbours(spark, "/root/testdata/sf0.01").collect():
        found[g.query_id].add(g.vec_id)
    hits = 0
    for q in (asked := ids[ids % 20 == 0]):
        s = np.where(ids == q, -np.inf, m @ m[ids == q][0])
        hits += len(found[q] & set(ids[np.argsort(-s, kind="stable")[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(asked)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rows = corpus(3) + [(2000 + i, f"{words(random.Random(i), 30)} vile vermin") for i in range(0, 60)]
    full = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i >= 2000)) for i, _ in rows], "doc_id long, quality int, toxic int")
    full.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    d = str(tmp_path)
    docs, work = spark.read.parquet(f"{d}/documents.parquet"), Workspace(spark, "test-pipeline")
    clean = work.write(p.drop_toxic(spark, docs, d), "clean")
    assert {x.doc_id for x in clean.collect()} == {i for i, _ in rows if i < 2000}
    once = work.write(p.drop_near_duplicates(spark, clean.unionByName(clean.filter("doc_id IN (1, 2)")), d), "once")
    groups = brute_components([(i, t) for i, t in rows if i < 2000])
    assert Counter(x.doc_id for x in once.collect()) == Counter(i for i, (_, c) in groups.items() if i == c)
    mixed = work.write(p.mix_sources(spark, once, d), "mixed")
    assert mixed.columns == once.columns == docs.columns
    packed = p.pack_sequences(spark, mixed, d)
    assert Counter(x.doc_id for x in packed.filter("piece = 0").collect()) == Counter(x.doc_id for x in mixed.collect())
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_duplicates", "mix", "pack"] and p.run(spark, d).count() > 0


def test_words_at_line_starts_need_no_pattern():
    """Letters behind a line feed, with a mark or without, are pieces of their own: the split pattern, which is slow, isn't asked."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from treeweave.llm.common import BpeCodec

    bpe, whole = BpeCodec(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    words = ["\nWord", "\nword,", "\nÉlan", "\nélan?", "\nx", "\nX."]
    want = [whole.encode(w, add_special_tokens=False).ids for w in words]
    odd = ["\n", "\n.", "\n..", "\n,a", "\nit's", "\nà1;", "\n1", "\nab́", "\nДа!", "a", "a.", ".", "é!", "it's"]
    assert [list(memoryview(bpe.word(w)).cast("H")) for w in odd] == [whole.encode(w if w[0] == "\n" else " " + w, add_special_tokens=False).ids for w in odd]
    bpe.split = None
    assert [list(memoryview(bpe.word(w)).cast("H")) for w in words] == want


def test_chosen_places_against_a_plain_loop():
    """Runs of one pair give every second place from the left; of touching ones the smaller rank goes first, then the left one."""
    r = random.Random(5)
    for _ in range(300):
        where = sorted(r.sample(range(60), r.randint(0, 40)))
        rank = [r.randrange(3) for _ in where]
        alive, k = [], 0
        for i, w in enumerate(where):
            k = k + 1 if i and where[i - 1] == w - 1 and rank[i - 1] == rank[i] else 0
            if k % 2 == 0:
                alive.append((rank[i], w))
        want: set[int] = set()
        for _, w in sorted(alive):
            if w - 1 not in want and w + 1 not in want:
                want.add(w)
        got = token_files._chosen(np.array(where, np.int64), np.array(rank, np.int16))
        assert {w for w, x in zip(where, got) if x} == want


def column(texts, kind="string"):
    import pyarrow as pa

    return pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.type_for_alias(kind))}).to_batches()[0]


def test_column_codec(library, monkeypatch):
    """Whole columns give the library's ids, with words that leave the cache, come back and are joined by few or many."""
    from treeweave.llm import column_codec as cc

    r = random.Random(3)
    some = ["<|endoftext|>", "<|endof", "text|>", "\n", " ", "  ", "a", "é", "foo", "Bar.", "'s", "12", "!?", "　", "\xa0", "᠎", "日本", "ɐx", "\t", "\t\n", "\x1c", "\r\n", "İ", "x́", "\x00", "ª", "²", "_", "\nfoo", "\n1.", "\x01"]
    texts = ODD + ["", "x" * 3000 + " y"] + [words(r, 200) for _ in range(20)]
    texts += ["".join(r.choice(some) for _ in range(r.randrange(1, 12))) for _ in range(2000)]
    texts += ["".join(r.choice([" ", "\n"]) + r.choice(some[6:]) + r.choice(["", "x", ".", "###", "'"]) for _ in range(8))[1:] for _ in range(500)]
    texts += ["".join(r.choice(["x", "Y.", "7", "'s", "é", "\t", "<|endoftext|>", ""]) + "".join(r.choice(" \n") for _ in range(r.choice([0, 1, 2, 3, 9]))) for _ in range(8)) for _ in range(500)]
    texts += [a + s * n + b for a in ("", "a") for b in ("", "b", "\n") for s in (" ", "\n", " \n") for n in (2, 30, 59, 60, 61, 62, 63, 64, 200)]
    want = [library(t) for t in texts]
    for chunk, kept, known, joined, kind in ((cc.CHUNK, cc.KEPT, cc.KNOWN, cc.JOINED, "string"), (2000, 2, 50, 3, "large_string"), (60, 1, 5, 1, "string")):
        for name, value in (("CHUNK", chunk), ("KEPT", kept), ("KNOWN", known), ("JOINED", joined)):
            monkeypatch.setattr(cc, name, value)
        c = cc.ColumnCodec(codec())
        got = list(c.rows(column(texts, kind).slice(2), "doc_id", "text"))
        assert [(i, np.frombuffer(x, "<u2").tolist()) for i, x in got] == list(enumerate(want))[2:] and len(c.words) <= known
        c.between = None
        assert c.encode(column(texts[:100]).column("text")) == [codec().encode(t) for t in texts[:100]]


def test_token_files_encode_plain_words_together(library, monkeypatch):
    """A shard's new plain words are told to the model many at a time, known ones not again, and no text word by word."""
    from types import SimpleNamespace

    import pyspark

    from treeweave.llm.common import BpeCodec

    calls, ids = [], BpeCodec._ids
    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    monkeypatch.setattr(BpeCodec, "encode", None)
    monkeypatch.setattr(BpeCodec, "word", None)
    monkeypatch.setattr(BpeCodec, "_ids", lambda self, coded: (calls.append(coded), ids(self, coded))[1])
    texts = ["\n".join(" ".join("qzx" + "äbcdefghij"[k % 10] * (k % 7) + chr(97 + k // 26 % 26) + chr(97 + k % 26) + ["", ",", "...", "###"][k % 4] for k in range(s, s + 50)) for s in range(d, d + 600, 50)) for d in range(30)]
    for most in (600 // 10, 10):
        (shard,) = token_files._encode(None, 2, 10**6)([column(texts)])
        got = token_files.Shard(*(shard.column(c)[0].as_py() for c in ("base", "rules", "lengths", "symbols", "marks"))).ids()
        assert got.tolist() == [x for t in texts for x in [*library(t), 2]] and len(calls) <= most
        calls.clear()


def test_runs_of_spaces_and_line_feeds_are_cut(library, monkeypatch):
    """Blank lines and indentation don't send a text through the split pattern."""
    from treeweave.llm import column_codec as cc
    from treeweave.llm.common import BpeCodec

    texts = ["\n\nOne two.\n\n\nThree:\n    four  five\n", " six ", "  \n", "\n", "  x", "", None]
    c = cc.ColumnCodec(BpeCodec())
    c.bpe.split = None
    monkeypatch.setattr(BpeCodec, "encode", None)
    assert [np.frombuffer(x, "<u2").tolist() for x in c.encode(column(texts).column("text"))] == [library(t) for t in texts]


def test_token_files_tasks_hand_back_memory(monkeypatch):
    """Workers outlive their tasks: a task gives the memory it has freed back, after its last shard."""
    from types import SimpleNamespace

    import pyspark

    freed = []
    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    monkeypatch.setattr(token_files, "release", lambda: freed.append(1))
    shards = token_files._encode(None, 2, 2)([column(["a b", "c"])])
    assert [len(freed) for _ in shards] == [0, 0] and freed == [1]
