import pytest
from pyspark.sql import functions as F

from tests.fixtures import CASES, bag, brute, frames, random_case
from treeweave.plans.contributions import contributions, count_output, max_participation, output_size, participation
from treeweave.plans.strategies import STRATEGIES, dangling, evaluate, full_reduce, materialize, plain
from treeweave.plans.targets import may_copy_out, select_target
from treeweave.plans.tree import CountOverflow, InvalidTree, JoinTree, OutputTooLarge, edge, from_arrays, is_acyclic


def build(spark, case):
    tables, parent, jp, jc = case
    return from_arrays(frames(spark, tables), parent, jp, jc)


@pytest.mark.parametrize("name", CASES)
def test_strategies_match_enumeration(spark, name):
    tree, expected = build(spark, CASES[name]), brute(*CASES[name])
    assert count_output(tree) == sum(expected.values())
    for s in STRATEGIES:
        assert bag(evaluate(tree, s)) == expected, s


@pytest.fixture
def as_shipped(spark):
    """Whole-stage code and adaptive plans, as a session has by default."""
    names = ("spark.sql.codegen.wholeStage", "spark.sql.adaptive.enabled")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "true")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("name", ["sample", "two_branches", "dangling", "repeated_rows"])
def test_strategies_with_default_plans(spark, as_shipped, name):
    tree, expected = build(spark, CASES[name]), brute(*CASES[name])
    for s in STRATEGIES:
        assert bag(evaluate(tree, s)) == expected, s


def test_cut(spark):
    tree, expected = build(spark, CASES["sample"]), brute(*CASES["sample"])
    out = materialize(tree, 7, cut=True)
    assert out.filter("__valid").count() == 7 and not bag(out.drop("__valid")) - expected
    assert materialize(tree, 25, cut=True).filter("NOT __valid").count() == 5


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_sweeps_read_each_table_once(spark, tmp_path, strategy):
    """Plans don't grow with the depth: no relation is scanned more often than the plan's own joins need."""
    tables = [[(i, i) for i in range(4)] for _ in range(6)]
    for i, t in enumerate(tables):
        spark.createDataFrame(t, "c0 long, c1 long").write.parquet(f"{tmp_path}/t{i}")
    tree = from_arrays([spark.read.parquet(f"{tmp_path}/t{i}") for i in range(6)], [-1, 0, 1, 2, 3, 4], [-1, 1, 1, 1, 1, 1], [-1, 0, 0, 0, 0, 0])
    out = evaluate(tree, strategy)
    assert sum(bag(out).values()) == 4
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # semi-joins of the root and of leaves, and the sums of a global prefix, read a written table once more
    assert plan.count("Relation [") <= {"native": 6, "yannakakis": 7, "positions": 12}[strategy]


@pytest.mark.parametrize("seed", range(4))
def test_random_trees(spark, seed):
    case = random_case(seed)
    tree, expected = build(spark, case), brute(*case)
    assert output_size(tree).first()[0] == sum(expected.values())
    for s in ("native", "positions"):
        assert bag(evaluate(tree, s)) == expected, s


def test_positions_are_gapless(spark):
    tree = build(spark, CASES["sample"])
    assert sorted(r.pos for r in evaluate(tree, "positions", with_position=True).collect()) == list(range(20))


def test_null_keys_never_match(spark):
    tables = [[(None, 1), (1, 2)], [(None, 3), (1, 4)]]
    tree = from_arrays(frames(spark, tables), [-1, 0], [-1, 0], [-1, 0])
    for s in STRATEGIES:
        assert bag(evaluate(tree, s)) == {(1, 2, 1, 4): 1}
    assert count_output(tree) == 1


def test_columns_and_orders(spark):
    a, b, c, d = (spark.createDataFrame([(1, i)], "k long, v long") for i in range(4))
    tree = JoinTree({"a": a, "b": b, "c": c, "d": d}, [edge("b", "a", "k"), edge("d", "a", "k"), edge("c", "b", "k")], "a", {"c": ["v"]})
    assert evaluate(tree).columns == ["a_k", "a_v", "b_k", "b_v", "c_v", "d_k", "d_v"]
    assert evaluate(tree, column_order="bfs").columns == ["a_k", "a_v", "b_k", "b_v", "d_k", "d_v", "c_v"]
    assert bag(evaluate(tree)) == {(1, 0, 1, 1, 2, 1, 3): 1}


def test_composite_keys(spark):
    a = spark.createDataFrame([(1, 2), (1, 3)], "x long, y long")
    b = spark.createDataFrame([(1, 2, 9), (1, 4, 8), (None, 2, 7)], "p long, q long, z long")
    tree = JoinTree({"a": a, "b": b}, [edge("b", "a", ["p", "q"], ["x", "y"])], "a")
    for s in STRATEGIES:
        assert bag(evaluate(tree, s)) == {(1, 2, 1, 2, 9): 1}


@pytest.mark.parametrize("extra", [0, 1, 5])
@pytest.mark.parametrize("name", ["inherited_stride", "dangling", "no_match", "single", "root_is_second"])
def test_padding(spark, name, extra):
    tree, expected = build(spark, CASES[name]), brute(*CASES[name])
    out = materialize(tree, sum(expected.values()) + extra)
    assert out.count() == sum(expected.values()) + extra
    assert bag(out.filter("__valid").drop("__valid")) == expected


def test_limits_and_errors(spark):
    tree = from_arrays(frames(spark, [[(1, 0)], [(1, 0), (1, 1)]]), [-1, 0], [-1, 0], [-1, 0])
    with pytest.raises(OutputTooLarge) as e:
        evaluate(tree, max_rows=1)
    assert e.value.exact_rows == 2
    with pytest.raises(OutputTooLarge):
        materialize(tree, 1)
    two = frames(spark, [[(1, 0)], [(1, 0)]])
    for parent, jp, jc in (([1, 0], [0, 0], [0, 0]), ([-1, -1], [-1, -1], [-1, -1]), ([-1, 5], [-1, 0], [-1, 0]), ([-1, 0], [-1, 7], [-1, 0])):
        with pytest.raises(InvalidTree):
            from_arrays(two, parent, jp, jc)
    with pytest.raises(InvalidTree):
        JoinTree({"a": two[0], "b": two[1], "c": two[0]}, [edge("b", "c", "c0"), edge("c", "b", "c0")], "a")
    with pytest.raises(ValueError):
        evaluate(tree, "other")


def test_count_overflow_and_saturation(spark):
    hot = spark.range(100_000).select(F.lit(1).cast("long").alias("c0"), "id")
    n = 5
    tree = from_arrays([hot] * n, [-1] + [0] * (n - 1), [-1] + [0] * (n - 1), [-1] + [0] * (n - 1))
    with pytest.raises(CountOverflow):
        count_output(tree)
    assert count_output(tree, saturate=True) == 2**63 - 1


def test_contributions_keep_dangling_rows(spark):
    tree = build(spark, CASES["dangling"])
    assert bag(plain(contributions(tree)["R0"], "R0").select("c0", "delta")) == {(0, 0): 1, (1, 0): 1, (2, 1): 1, (3, 0): 1}


@pytest.mark.parametrize("name", ["sample", "two_branches", "dangling", "repeated_rows"])
def test_reduction_and_participation(spark, name):
    tables, parent, jp, jc = CASES[name]
    tree, expected = build(spark, CASES[name]), brute(*CASES[name])
    at = 0
    reduced, shares = full_reduce(tree), participation(tree)
    most = {r.relation: r.max_participation for r in max_participation(tree).collect()}
    for i, t in enumerate(tables):
        width, name_ = len(t[0]), f"R{i}"
        inside = {k[at : at + width] for k in expected}
        columns = [f"c{j}" for j in range(width)]
        assert bag(plain(reduced[name_], name_).select(*columns)) == {r: t.count(r) for r in t if r in inside}
        assert bag(dangling(tree, name_).select(*columns)) == {r: t.count(r) for r in t if r not in inside}
        counts = {r: sum(n for k, n in expected.items() if k[at : at + width] == r) // t.count(r) for r in t}
        got = plain(shares[name_], name_)
        assert {tuple(x)[:-1]: x.participation for x in got.select(*columns, "participation").collect()} == counts
        assert most[name_] == max(counts.values())
        at += width


def test_target_policies(spark):
    tree, empty = build(spark, CASES["sample"]), build(spark, CASES["no_match"])
    assert select_target(tree).rows == 20 and select_target(empty).rows == 1
    assert select_target(tree, "public", 7).rows == 7 and not may_copy_out(select_target(tree, "public", 7))
    assert select_target(tree, "simulation", epsilon=4.0, delta=1e-6).rows > 20
    for arguments in (("public", 0), ("simulation", 3), ("exact", -1), ("other", 1)):
        with pytest.raises(ValueError):
            select_target(tree, *arguments)
    with pytest.raises(OutputTooLarge):
        select_target(tree, "public", 100, max_rows=99)


def test_acyclicity():
    assert is_acyclic({"r": {"a", "b"}, "s": {"b", "c"}, "t": {"c", "d"}})
    assert is_acyclic({"r": {"a", "b", "c"}, "s": {"a", "b"}, "t": {"c"}})
    assert not is_acyclic({"r": {"a", "b"}, "s": {"b", "c"}, "t": {"c", "a"}})


def test_positions_broadcast_no_copies(spark):
    """Three rows a side stand for 300,000 copies, which neither side of a join may send to the driver."""
    three = spark.range(3).select(F.col("id").alias("k"))
    many = spark.range(300_000).select((F.col("id") % 3).alias("k"), "id")
    tree = JoinTree({"a": three, "b": three, "c": many}, [edge("b", "a", "k"), edge("c", "b", "k")], "a")
    out = evaluate(tree, "positions", with_position=True)
    joins = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "__slot" in x and "Join" in x]
    assert len(joins) == 2 and not any("Broadcast" in x for x in joins)
    facts = out.agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.count_distinct("pos").alias("numbers"), F.count_distinct("id").alias("rows"), F.count_if(F.expr("a_k = b_k AND b_k = c_k")).alias("same"))
    assert tuple(facts.first()) == (300_000, 0, 299_999, 300_000, 300_000, 300_000)


@pytest.mark.parametrize("name", ["no_match", "empty_root", "empty_child", "empty_inner"])
def test_saturated_count_of_an_empty_output(spark, name):
    tree = build(spark, CASES[name])
    assert count_output(tree, saturate=True) == count_output(tree) == 0


def test_positions_broadcast_no_large_relation(spark, tmp_path):
    """300,000 rows of one value fill a file of a few KB, which Spark would broadcast for its size; with many rows on both sides it may not."""
    spark.range(300_000).selectExpr("CAST(1 AS BIGINT) AS k", "id DIV 300000 AS v").coalesce(1).write.parquet(f"{tmp_path}/same")
    same = spark.read.parquet(f"{tmp_path}/same")
    many = spark.range(300_000).select((F.col("id") + 1).alias("k"), "id")
    tree = JoinTree({"a": same, "b": many}, [edge("b", "a", "k")], "a")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().splitlines()
    seen = [x for x in plan(contributions(tree, keep_dangling=False, n_rows={"a": 300_000, "b": 300_000})["a"]) if "Join" in x]
    out = evaluate(tree, "positions", with_position=True)
    seen += [x for x in plan(out) if "LeftSemi" in x]
    assert len(seen) == 2 and all("SortMergeJoin" in x for x in seen)
    assert tuple(out.agg(F.count("*"), F.count_distinct("pos"), F.max("id")).first()) == (300_000, 300_000, 0)
