import itertools

import pytest
from pyspark.sql import functions as F

from tests.fixtures import bag
from treeweave.functions.columns import dense_ids, first_per_group, in_sample, like_filter, sample_bucket
from treeweave.operators import aggregates, joins, scans, sets, shape


def test_expand(spark):
    df = spark.createDataFrame([(7, 0), (8, 1), (9, 0), (5, 3)], "v long, n int")
    assert bag(shape.expand(df, "n", 4).select("v")) == {(8,): 1, (5,): 3}
    assert shape.expand(df.withColumn("n", F.lit(0)), "n").count() == 0
    with pytest.raises(ValueError):
        shape.expand(df, "n", 5)
    with pytest.raises(ValueError):
        shape.expand(df.withColumn("n", F.col("n") - 1), "n")
    assert shape.expand_to(df, "n", 9, ["v"]).filter("__valid").count() == 6
    assert shape.expand_to(df, "n", 4, ["v"]).count() == 4


def test_compact_and_pad(spark):
    df = spark.createDataFrame([(i, i % 2 == 0) for i in range(6)], "v long, keep boolean")
    assert bag(shape.compact(df, F.col("keep")).select("v")) == {(0,): 1, (2,): 1, (4,): 1}
    out = shape.compact_keeping(df, F.col("keep"), 5, ["v"])
    assert out.count() == 5 and out.filter("__valid").count() == 3
    with pytest.raises(ValueError):
        shape.pad_to(df, 2, strict=True)
    assert [r.v for r in shape.sort_rows(spark.createDataFrame([(2,), (None,), (1,)], "v long"), ["v"]).collect()] == [1, 2, None]


@pytest.fixture(params=["by group", "by parts"])
def scanned(request, spark, monkeypatch):
    """Scans by group, and as for groups too large for a task, over six range partitions."""
    if request.param == "by parts":
        monkeypatch.setattr(scans, "HOT", 0)
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "6")
        yield
        spark.conf.set("spark.sql.shuffle.partitions", before)
    else:
        yield


def test_hot_groups(spark, scanned):
    """One group of three quarters of the rows, null keys and values, and an order downwards, against plain Python."""
    rows = [(None if i % 11 == 0 else 1 if i % 4 else 2, i, None if i % 5 == 0 else i % 7) for i in range(200)]
    df = spark.createDataFrame(rows, "g long, i long, v long")
    got = {r.i: (r.s, r.f, r.h) for r in scans.rank_offset(scans.forward_fill(scans.prefix_sum(df, "v", ["g"], [F.desc("i")], "s"), ["v"], F.col("i") % 30 == 0, ["g"], ["i"]).withColumnRenamed("filled_v", "f"), ["g"], None, ["i"]).collect()}
    for g, i, _ in rows:
        headers = [v for a, b, v in rows if a == g and b <= i and b % 30 == 0]
        assert got[i] == (sum(v or 0 for a, b, v in rows if a == g and b > i), headers[-1] if headers else None, sum(1 for a, b, _ in rows if a == g and b < i))
    empty = df.limit(0)
    assert scans.prefix_sum(empty, "v", ["g"], ["i"], "s").count() == 0 and scans.number_copies(empty).count() == 0


def test_scans(spark, scanned):
    rows = [(g, i, (g * 7 + i * 3) % 5) for g in range(3) for i in range(5)]
    df = spark.createDataFrame(rows, "g long, i long, v long")
    for inclusive, reverse in itertools.product((False, True), (False, True)):
        f = scans.suffix_sum if reverse else scans.prefix_sum
        got = {(r.g, r.i): r.s for r in f(df, "v", ["g"], ["i"], "s", inclusive=inclusive).collect()}
        for g, i, _ in rows:
            inside = [v for a, b, v in rows if a == g and ((b > i) if reverse else (b < i)) or (inclusive and (a, b) == (g, i))]
            assert got[g, i] == sum(inside)
    assert {r.g: r.s for r in scans.group_total(df, "v", ["g"], "s").collect()} == {g: sum(v for a, _, v in rows if a == g) for g in range(3)}
    filled = scans.forward_fill(df, ["v"], F.col("i") % 2 == 0, ["g"], ["i"])
    assert {(r.g, r.i): r.filled_v for r in filled.collect()} == {(g, i): next(v for a, b, v in rows if a == g and b == i - i % 2) for g, i, _ in rows}


def test_numbering(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 1), (2, 0)], "a long, b long")
    assert bag(scans.number_copies(df)) == {(1, 1, 1): 1, (1, 1, 2): 1, (1, 1, 3): 1, (2, 0, 1): 1}
    assert bag(scans.number_copies(df, modulo=2)) == {(1, 1, 1): 2, (1, 1, 2): 1, (2, 0, 1): 1}
    many = spark.range(1000).select((F.col("id") % 37).alias("a"), F.col("id").alias("b"))
    expected = sorted((i % 37, i) for i in range(1000))
    assert [tuple(r)[:2] for r in sorted(scans.global_position(many, ["a", "b"]).collect(), key=lambda r: r.pos)] == expected
    sums = scans.global_prefix(many, F.col("a"), ["a", "b"], "s").collect()
    total, want = 0, {}
    for a, b in expected:
        want[a, b] = total
        total += a
    assert {(r.a, r.b): r.s for r in sums} == want
    six = spark.range(6).select(scans.aligned_position(F.col("id"), F.lit(2), F.lit(3)).alias("o"))
    assert sorted(r.o for r in six.collect()) == list(range(6))


def test_joins(spark, scanned):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z"), (1, "w")], "k long, p string")
    b = spark.createDataFrame([(1, 5), (1, 6), (3, 7), (None, 8)], "k long, q long")
    assert joins.equi_join(a, b, ["k"], ["k"]).count() == 4
    assert joins.equi_join(a, b, ["k"], ["k"], size=6).count() == 6
    assert bag(joins.semi_join(a, b, ["k"], ["k"])) == {(1, "x"): 1, (1, "w"): 1}
    assert bag(joins.anti_join(a, b, ["k"], ["k"])) == {(2, "y"): 1, (None, "z"): 1}
    assert bag(joins.group_join(a, b, ["k"], ["k"])) == {(1, "x", 2): 1, (1, "w", 2): 1, (2, "y", 0): 1, (None, "z", 0): 1}
    assert bag(joins.group_join(a, b, ["k"], ["k"], "q")) == {(1, "x", 11): 1, (1, "w", 11): 1, (2, "y", 0): 1, (None, "z", 0): 1}
    assert bag(joins.semi_join_counts(a, b, ["k"], ["k"])) == {(1, "x", 2): 1, (1, "w", 2): 1, (0, None, 0): 2}
    assert bag(joins.augment(a, b, ["k"], ["k"])) == {(1, "x", 2): 1, (1, "w", 2): 1}
    starts = spark.createDataFrame([(1, 0, "a"), (1, 10, "b"), (2, 5, "c")], "k long, s long, v string")
    at = spark.createDataFrame([(1, 3), (1, 10), (1, 99), (2, 4), (2, 5)], "k long, t long")
    assert bag(joins.range_lookup(at, starts, ["k"], "t", "s", ["v"])) == {(1, 3, "a"): 1, (1, 10, "b"): 1, (1, 99, "b"): 1, (2, 5, "c"): 1}


def test_aggregates(spark):
    df = spark.createDataFrame([(k,) for k in [1, 1, 1, 2, 2, 3]], "k long")
    assert bag(aggregates.reduce_by_key(df, ["k"])) == {(1, 3): 1, (2, 2): 1, (3, 1): 1}
    assert aggregates.max_frequency(df, ["k"]).first()[0] == 3 and aggregates.max_frequency(df, []).first()[0] == 6
    assert aggregates.max_frequency(df.limit(0), ["k"]).first()[0] == 0
    stats = aggregates.frequency_stats(df, "k").first()
    f = [1, 2, 3]
    assert stats.gini == pytest.approx(2 * sum((i + 1) * x for i, x in enumerate(f)) / (3 * 6) - 4 / 3) and (stats.max_frequency, stats.n_keys) == (3, 3)
    one, two = aggregates.bag_fingerprint(df).first(), aggregates.bag_fingerprint(df.orderBy(F.desc("k"))).first()
    assert one == two != aggregates.bag_fingerprint(df.withColumn("k", F.col("k") + 1)).first()
    assert bag(aggregates.group_sizes(df, spark.createDataFrame([(3,), (4,)], "k long"), ["k"]).select("k", "tid", "n_left", "n_right")) == {(1, 1, 3, 0): 3, (2, 1, 2, 0): 2, (3, 1, 1, 1): 1, (3, 2, 1, 1): 1, (4, 2, 0, 1): 1}
    assert aggregates.product_count([df, df], "k").first()[0] == 14


def test_sets_and_keys(spark):
    e = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (4, 1)], "source long, target long")
    assert sets.distinct_rows(e).count() == 3
    assert bag(sets.unprobed(e, "source", e, "target")) == {(4, 1): 1}
    assert bag(dense_ids(e, ["source", "target"], "id")) == {(1, 2, 0): 1, (2, 3, 1): 1, (4, 1, 2): 1}
    assert bag(first_per_group(e, ["source"], ["target"], 1)) == {(1, 2): 1, (2, 3): 1, (4, 1): 1}


def test_sample_buckets(spark):
    ids = [0, 1, 2, 12345, 2**31 - 1, 2**31, 2**40 + 17, -1, -(2**40)]
    got = {r.k: r.b for r in spark.createDataFrame([(i,) for i in ids], "k long").select("k", sample_bucket(F.col("k")).alias("b")).collect()}
    assert got == {i: ((i * 2_654_435_761) & 0xFFFFFFFF) % 100 for i in ids}
    df = spark.range(1000).select(in_sample(F.col("id"), 20).alias("a"), in_sample(F.col("id"), 60).alias("b"))
    assert df.filter("a AND NOT b").count() == 0 < df.filter("a").count()


def test_like_filter(spark):
    df = spark.createDataFrame([("x (presents)",), ("x (co-production) (as M)",), ("none",), (None,)], "t string")
    assert [r.t for r in df.filter(like_filter(F.col("t"), ["(presents)", "(co-production)"], ["(as M)"])).collect()] == ["x (presents)"]


def test_many_copies_of_a_row(spark, monkeypatch):
    """Copies are made block by block."""
    from treeweave.operators import shape

    df = spark.createDataFrame([(1, 3_000_000), (2, 0), (3, 65_536), (4, 65_537)], "k long, n long")
    got = {x.k: (x.c, x.lo, x.hi, x.s) for x in shape.expand(df, "n", index="i").groupBy("k").agg(F.count("*").alias("c"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.sum("i").alias("s")).collect()}
    assert got == {k: (n, 0, n - 1, n * (n - 1) // 2) for k, n in ((1, 3_000_000), (3, 65_536), (4, 65_537))}
    monkeypatch.setattr(shape, "BLOCK", 3)
    some = shape.with_numbers(spark.createDataFrame([(5, 7), (9, -1), (2, 3), (1, 1)], "a long, n long"), F.col("a"), F.col("n"), "i")
    assert sorted((x.a, x.i) for x in some.collect()) == [(1, 1), (2, 2), (2, 3), (2, 4), *((5, i) for i in range(5, 12))] and some.columns == ["a", "n", "i"]


def test_rows_with_bars_are_checked(spark, tmp_path):
    from treeweave.sources import files

    columns = {"a": "bigint", "b": "string", "c": "double"}
    write = lambda name, *lines: (tmp_path / name).write_text("\n".join(lines) + "\n")
    write("good", "1|x|2.5|", "2||", "", "3|y|1|")
    assert [tuple(x) for x in files.read_bars(spark, str(tmp_path / "good"), columns).collect()] == [(1, "x", 2.5), (2, None, None), (3, "y", 1.0)]
    assert files.read_bars(spark, str(tmp_path / "good"), columns, empty_as_zero=True).filter("a = 2").first().c == 0.0
    for bad in ("1|x", "1|x|2|3", "one|x|2|"):
        write("bad", bad)
        with pytest.raises(Exception):
            files.read_bars(spark, str(tmp_path / "bad"), columns).collect()
