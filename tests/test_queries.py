"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from treeweave.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(rows):
    clean = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else x
    return sorted(([str(clean(x)) for x in r] for r in rows))


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, FOLDER)
    got = db.sql(registry.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(got.columns)
    assert plain(df.select(*columns).collect()) == plain(got.select(*columns).fetchall())


def test_entry_imports():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_like_predicates_drops_the_word_of_its_sql(spark, tmp_path):
    spark.createDataFrame([(1, "red anvil"), (2, "blue anvil"), (3, "small ring"), (4, None)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    assert {r.p_partkey for r in registry.QUERIES["like_predicates"](spark, str(tmp_path)).collect()} == {2, 3}


def test_suite_sizes(spark):
    """Every node of a core has as many edges as asked for, so a tree's size is the nodes times the product of the degrees; a series has one core."""
    from treeweave.plans import graphs
    from treeweave.plans.contributions import count_output

    edges = spark.createDataFrame([(a, b) for a in range(9) for b in range(9) if a != b] + [(20, 1), (21, 20)], "source long, target long")
    nodes = {}
    for case, tree in graphs.suite_trees(edges, ["depth_d2_m9_medium", "depth_d4_m9_large", "branch_b3_m9_medium", "relations_m5_d2_b3", "relations_m7_d2_b3"]).items():
        size, product = count_output(tree), math.prod(graphs.suite_cases()[case][1])
        assert size % product == 0 and 4 <= size // product <= 9
        nodes.setdefault(case.split("_")[0], set()).add(size // product)
    assert all(len(n) == 1 for n in nodes.values()) and len(graphs.suite_cases()) == 15


def test_hubs_and_cores(spark):
    """The largest set of nodes with so many targets inside, and hubs, against plain Python."""
    import random

    from treeweave.plans import graphs

    r = random.Random(3)
    pairs = {(r.randrange(40), r.randrange(40)) for _ in range(230)}
    edges = spark.createDataFrame(sorted(pairs), "source long, target long")
    alive = {x for e in pairs for x in e}
    while True:
        left = {a for a in alive if sum(1 for s, t in pairs if s == a and t in alive) >= 3}
        if left == alive:
            break
        alive = left
    want = {(a, t) for a in alive for t in sorted(t for s, t in pairs if s == a and t in alive)[:3]}
    assert alive and {(x.source, x.target) for x in graphs.out_core(edges, 3).collect()} == want

    out = {a: sorted(t for s, t in pairs if s == a) for a in range(40)}
    middle = {a: sorted((t for t in out[a] if out[t]), key=lambda t: (-len(out[t]), t))[:2] for a in out}
    score = {a: sum(min(len(out[t]), 2) ** 2 for t in middle[a]) for a in out if middle[a] and any(t == a for _, t in pairs)}
    hubs = sorted(score, key=lambda a: (-score[a], -a))[:3]
    want = {(s, h) for h in hubs for s in sorted(s for s, t in pairs if t == h)[:4]}
    want |= {(h, t) for h in hubs for t in middle[h]} | {(t, x) for h in hubs for t in middle[h] for x in out[t][:2]}
    assert {(x.source, x.target) for x in graphs.hub_edges(edges, 3, 4, 2, 2).collect()} == want


def test_chain_positions_broadcast_no_copies(spark, tmp_path):
    """Few customers and orders with 240,000 lines: their copies are joined by shuffles, and the rows are those of the plain join."""
    lines = spark.range(240_000).selectExpr("id % 50 AS l_orderkey", "CAST(id AS INT) AS l_linenumber", "id % 7 AS l_partkey", "id % 3 AS l_suppkey")
    for name, df in (("customer", spark.range(12).selectExpr("id AS c_custkey", "1 AS c_nationkey")), ("orders", spark.range(60).selectExpr("id AS o_orderkey", "id % 11 AS o_custkey")), ("lineitem", lines)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    out = registry.QUERIES["chain3_positions"](spark, str(tmp_path))
    joins = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "__slot" in x and "Join" in x]
    assert len(joins) == 2 and not any("Broadcast" in x for x in joins)
    bag = lambda df: tuple(df.selectExpr("count(*)", "sum(CAST(xxhash64(*) AS DECIMAL(38, 0)))").first())
    assert bag(out) == bag(registry.QUERIES["chain3_join"](spark, str(tmp_path))) and out.count() == 240_000


@pytest.fixture(scope="module")
def long_chain(spark, tmp_path_factory):
    """A chain with more than a million rows, in which the order of most lines isn't one of the customer with most orders."""
    path = tmp_path_factory.mktemp("long")
    lines = spark.range(1_000_100).selectExpr("IF(id < 700, 1999, id % 2000) AS l_orderkey", "CAST(id AS INT) AS l_linenumber", "id % 7 AS l_partkey", "id % 3 AS l_suppkey")
    for name, df in (("customer", spark.range(20).selectExpr("id AS c_custkey", "1 AS c_nationkey")), ("orders", spark.range(2000).selectExpr("id AS o_orderkey", "IF(id < 300, 0, id % 20) AS o_custkey")), ("lineitem", lines)):
        df.write.parquet(f"{path}/{name}.parquet")
    c = duckdb.connect()
    for name in ("customer", "orders", "lineitem"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    return str(path), c


@pytest.mark.parametrize("name", ["boundary_bounds", "padded_target", "sensitivity_final"])
def test_sensitivity_of_a_long_chain(spark, long_chain, name):
    folder, db = long_chain
    df = registry.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    assert plain(df.select(*columns).collect()) == plain(db.sql(registry.ORACLE_SQL[name]).select(*columns).fetchall())


def chain_folder(spark, path, customers, orders, lines):
    """A chain from pairs of keys, and a database over it."""
    c = duckdb.connect()
    for name, columns, rows in (("customer", "c_custkey long, c_nationkey long", customers), ("orders", "o_orderkey long, o_custkey long", orders), ("lineitem", "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long", [(*x, 1, 1) for x in lines])):
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{path}/{name}.parquet")
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    return c


def same_as_sql(spark, folder, db, name):
    df = registry.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    return plain(df.select(*columns).collect()) == plain(db.sql(registry.ORACLE_SQL[name]).select(*columns).fetchall())


def test_padded_target_of_an_empty_chain(spark, tmp_path):
    """Orders of unknown customers: the chain has no rows."""
    db = chain_folder(spark, tmp_path, [(1, 1), (2, 1)], [(1, 7), (2, 7), (3, 8)], [(i % 3 + 1, i) for i in range(9)])
    assert same_as_sql(spark, tmp_path, db, "padded_target")


ODD_CHAINS = {
    "no line matches": ([(1, 1), (2, 1)], [(i, i % 2 + 1) for i in range(30)], [(i % 9 + 100, i) for i in range(60)]),
    "no order matches": ([(1, 1), (2, 1)], [(1, 7), (2, 7), (3, 8)], [(i % 3 + 1, i) for i in range(9)]),
    "no customers": ([], [(i, i % 2) for i in range(30)], [(99, i) for i in range(20)] + [(1, 1)]),
    "no orders": ([(1, 1), (1, 1)], [], [(i % 9, i) for i in range(60)]),
    "no lines": ([(1, 1), (1, 1)], [(1, 1), (1, 2), (1, 2)], []),
    "nothing": ([], [], []),
    "null keys": ([(None, 1), (None, 1), (1, 1)], [(None, 1), (None, None), (1, None), (2, 1)], [(None, 1), (None, 2), (1, 3), (2, 4)]),
}


@pytest.mark.parametrize("case", ODD_CHAINS)
def test_bounds_of_odd_chains(spark, tmp_path, case):
    """Sets of relations of which no rows meet, and empty tables, have the bounds of the SQL."""
    db = chain_folder(spark, tmp_path, *ODD_CHAINS[case])
    assert [n for n in ("boundary_bounds", "sensitivity_final", "padded_target") if not same_as_sql(spark, tmp_path, db, n)] == []
