import gzip
import itertools
import math

import pytest
from pyspark.sql import functions as F

from tests.fixtures import CASES, bag, brute, frames
from treeweave.plans import graphs
from treeweave.plans.contributions import count_output
from treeweave.plans.profile import plan_text, profile_tree
from treeweave.plans.sensitivity import SizeModel, noise_factor, padded_size, residual, smoothing
from treeweave.plans.strategies import evaluate
from treeweave.plans.tree import InvalidTree, OutputTooLarge, from_arrays
from treeweave.sources import files


def test_text_tables(spark, tmp_path):
    (tmp_path / "a.tbl").write_text("1  2\n\n 3\t4 \n")
    assert bag(files.read_table(spark, f"{tmp_path}/a.tbl", 2)) == {(1, 2): 1, (3, 4): 1}
    with pytest.raises(ValueError):
        files.read_table(spark, f"{tmp_path}/a.tbl", 3)
    (tmp_path / "b.tbl").write_text("\n")
    with pytest.raises(ValueError):
        files.read_table(spark, f"{tmp_path}/b.tbl", 1)
    (tmp_path / "x.dat").write_text("1||abc|\n2|5|d|\n")
    columns = {"a": "long", "b": "long", "c": "string"}
    assert bag(files.read_bars(spark, f"{tmp_path}/x.dat", columns)) == {(1, None, "abc"): 1, (2, 5, "d"): 1}
    assert bag(files.read_bars(spark, f"{tmp_path}/x.dat", columns, empty_as_zero=True)) == {(1, 0, "abc"): 1, (2, 5, "d"): 1}
    with gzip.open(tmp_path / "q.csv.gz", "wt") as f:
        f.write('1,"a,\\"b",3\n')
    assert bag(files.read_quoted_csv(spark, f"{tmp_path}/q.csv.gz", {"i": "long", "t": "string", "j": "long"})) == {(1, 'a,"b', 3): 1}
    (tmp_path / "e.txt").write_text("# from to\n1\t2\n3 4\n")
    assert bag(files.read_edges(spark, f"{tmp_path}/e.txt")) == {(1, 2): 1, (3, 4): 1}


def test_tree_folder_round_trip(spark, tmp_path):
    tables, parent, jp, jc = CASES["sample"]
    tree = from_arrays(frames(spark, tables), parent, jp, jc)
    files.write_tree(tree, str(tmp_path), 20, {"relations": 6})
    again = files.read_tree(spark, str(tmp_path))
    assert bag(evaluate(again)) == brute(*CASES["sample"]) and files.read_expected(spark, f"{tmp_path}/expected.txt") == 20
    assert files.read_stats(spark, f"{tmp_path}/stats.txt") == {"relations": "6"}
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "tree.txt").write_text("0 -1 -1 -1 2\n1 0 0 0 2\n")
    (bad / "tables.tbl").write_text("0 1 2\n1 1\n")
    with pytest.raises(InvalidTree):
        files.read_tree(spark, str(bad))


def test_named_workload(spark, tmp_path):
    names, parent, jp, jc = files.WORKLOADS["q85_chain"]
    for name, width in names.items():
        (tmp_path / name).write_text("".join(" ".join(["1"] * width) + "\n" for _ in range(2)))
    assert count_output(files.read_workload(spark, "q85_chain", str(tmp_path))) == 8
    rows = {"lineitem_sk_pk_ok.txt": "1 2 3\n1 9 3\n", "orders_ok.txt": "3\n", "partsupp.txt": "2 1\n", "part.txt": "2\n", "supplier_sk_nk.txt": "1 7\n", "nation.txt": "7\n"}
    for name, text in rows.items():
        (tmp_path / name).write_text(text)
    assert count_output(files.read_product_profit(spark, str(tmp_path))) == 1


def test_archive(spark, tmp_path):
    import tarfile

    (tmp_path / "a.csv").write_text('1,"x, y"\n' * 3)
    (tmp_path / "b.csv").write_text("")
    with tarfile.open(tmp_path / "all.tgz", "w:gz") as t:
        t.add(tmp_path / "a.csv", "inner/a.csv")
        t.add(tmp_path / "b.csv", "inner/b.csv")
    paths = files.unpack(spark, f"{tmp_path}/all.tgz", f"{tmp_path}/out")
    assert paths == [f"{tmp_path}/out/a.csv.gz", f"{tmp_path}/out/b.csv.gz"]
    assert bag(files.read_quoted_csv(spark, paths[0], {"i": "long", "t": "string"})) == {(1, "x, y"): 3}
    with tarfile.open(tmp_path / "twice.tgz", "w:gz") as t:
        t.add(tmp_path / "a.csv", "one/a.csv")
        t.add(tmp_path / "a.csv", "two/a.csv")
    with pytest.raises(ValueError):
        files.unpack(spark, f"{tmp_path}/twice.tgz", f"{tmp_path}/again")


def test_counts_that_stop(spark):
    from treeweave.plans import workloads
    from treeweave.plans.strategies import count_up_to

    tree = workloads.sample(spark)
    assert [count_up_to(tree, n) for n in (0, 19, 20, 100)] == [1, 20, 20, 20] and count_output(tree) == 20


def test_sinks(spark):
    df = spark.range(10).select("id", F.col("id").alias("b"))
    assert len(files.copy_out(df, 20)) == 10 and files.summary(df) == (10, 2) and files.first_rows(df, 0) == []
    with pytest.raises(OutputTooLarge):
        files.copy_out(df, 19)


def brute_residual(bounds, m, beta):
    best = 0.0
    top = int((m - 1) / beta) + m
    for gone in range(m):
        others = [r for r in range(m) if r != gone]
        for ks in itertools.product(range(top + 1), repeat=len(others)):
            if sum(ks) > top:
                continue
            total = 0.0
            for chosen in itertools.product((0, 1), repeat=len(others)):
                mask = sum(1 << r for r, c in zip(others, chosen) if c)
                total += bounds.get(mask, 1) * math.prod(k for k, c in zip(ks, chosen) if not c)
            best = max(best, math.exp(-beta * sum(ks)) * total)
    return max(1, math.ceil(best))


@pytest.mark.parametrize("m", [3, 4])
def test_residual_matches_enumeration(m):
    bounds = {e: 1 + (e * 7) % 11 for e in range(1, (1 << m) - 1)}
    assert residual(bounds, m, 0.9) == brute_residual(bounds, m, 0.9)
    assert residual({}, 1, 0.5) == 1


def test_sensitivity_of_a_chain(spark):
    tables = [[(1, 1), (2, 1)], [(1, 1), (1, 2), (1, 3)], [(1, 0), (2, 0), (2, 1)]]
    tree = from_arrays(frames(spark, tables), [-1, 0, 1], [-1, 1, 1], [-1, 0, 0])
    s = SizeModel(tree).compute(4.0, 1e-6)
    assert s.ok and not s.too_expensive and 1 <= s.final <= min(s.degree_only, s.consistent, s.relaxed, s.ceiling) and s.ceiling == 9
    assert smoothing(-1, 5) == smoothing(1.0, 1e-9)
    p = padded_size(tree, 4.0, 1e-6)
    assert p.exact_rows == count_output(tree) and p.target == p.exact_rows + math.ceil(noise_factor(4.0, 1e-6) * p.sensitivity)
    assert SizeModel(from_arrays(frames(spark, [[(1, 1)]] * 9), [-1] + [0] * 8, [-1] + [0] * 8, [-1] + [0] * 8)).compute(0.1, 1e-9).too_expensive


def test_tree_shape():
    s = graphs.tree_shape([-1, 0, 0, 1])
    assert (s.depth, s.branching, s.children[0]) == (2, 2, (1, 2))
    with pytest.raises(ValueError):
        graphs.tree_shape([-1, 2, 0])
    cases = graphs.suite_cases()
    assert len(cases) == 15 and all(graphs.tree_shape(p) and len(p) == len(d) for p, d in cases.values())


def test_graph_cores(spark):
    ring = [(i, (i + j) % 6) for i in range(6) for j in (1, 2)]
    tail = [(6, 0), (6, 7), (7, 6)]
    e = spark.createDataFrame(ring + tail, "source long, target long")
    assert {r.source for r in graphs.out_core(e, 2).collect()} == {0, 1, 2, 3, 4, 5}
    parts = {r.node: r.component for r in graphs.strong_components(e).collect()}
    assert {parts[i] for i in range(6)} == {5} and parts[6] == parts[7] == 7
    assert bag(graphs.sink_component_edges(e, 2)) == {x: 1 for x in ring}
    with pytest.raises(ValueError):
        graphs.out_core(e, 3)
    assert count_output(graphs.edge_tree(graphs.aliases(e.limit(0).unionByName(spark.createDataFrame(ring, "source long, target long")), 3), [-1, 0, 1])) == 6 * 2 * 2 * 2
    assert [t.count() for t in graphs.bounded_aliases(spark.createDataFrame(ring, "source long, target long"), [1, 2])] == [6, 12]


def test_equal_size_tables(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (8, 1), (9, 1), (7, 9)], "source long, target long")
    tables = graphs.equal_size_tables(e, e.filter("source IN (1, 2, 3)"), 6)
    assert {t.count() for t in tables} == {3}


def test_hubs(spark):
    edges = [(0, h) for h in (1, 2)] + [(1, m) for m in (3, 4)] + [(m, x) for m in (3, 4) for x in (5, 6, 7)] + [(2, 3)]
    got = bag(graphs.hub_edges(spark.createDataFrame(edges, "source long, target long"), 1, 5, 5, 2))
    assert got == {(0, 1): 1, (1, 3): 1, (1, 4): 1, (3, 5): 1, (3, 6): 1, (4, 5): 1, (4, 6): 1}


def test_profile(spark):
    tables, parent, jp, jc = CASES["two_branches"]
    p = profile_tree(from_arrays(frames(spark, tables), parent, jp, jc), warm=False)
    assert p.rows == 8 and set(p.seconds) == {"size", "reduce", "native", "yannakakis", "positions"}
    assert "Join" in plan_text(evaluate(from_arrays(frames(spark, tables), parent, jp, jc)))
