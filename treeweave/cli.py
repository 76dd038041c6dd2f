"""Command line: evaluate a workload folder or a built-in tree, by one or all strategies.

python -m treeweave.cli --tree FOLDER --strategy all --summary
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from .plans import workloads
from .plans.contributions import count_output
from .plans.profile import plan_text, profile_tree
from .plans.sensitivity import padded_size
from .plans.strategies import STRATEGIES, evaluate, materialize
from .plans.targets import MAX_ROWS, POLICIES, may_copy_out, select_target
from .session import session
from .sources import files

BUILT_IN = {"q9": workloads.product_profit, "chain": workloads.chain, "star": workloads.star, "snowflake": workloads.snowflake, "m2m": workloads.many_to_many, "same-dimension": workloads.same_dimension_twice, "q18": workloads.catalog_shape, "q85": workloads.returns_shape, "walks": workloads.two_step_walks, "job13d": workloads.supply_movies}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="treeweave", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--tree", metavar="FOLDER", help="tree.txt and tables.tbl")
    source.add_argument("--workload", nargs=2, metavar=("NAME", "FOLDER"), help=f"one of {', '.join(files.WORKLOADS)} or tpch9")
    source.add_argument("--tables", nargs=2, metavar=("NAME", "FOLDER"), help=f"one of {', '.join(BUILT_IN)} over Parquet tables")
    source.add_argument("--sample", action="store_true", help="a tree of six small relations with 20 rows")
    p.add_argument("--strategy", choices=[*STRATEGIES, "all"], default="native")
    p.add_argument("--summary", action="store_true", help="count rows and columns only")
    p.add_argument("--bench", action="store_true", help="make the rows, keep none, print seconds by stage")
    p.add_argument("--explain", action="store_true")
    p.add_argument("--size", action="store_true", help="the exact size, counted without making the rows")
    p.add_argument("--policy", choices=POLICIES, help="materialize for this target policy, padded")
    p.add_argument("--target", type=int, default=0)
    p.add_argument("--epsilon", type=float, default=1.0)
    p.add_argument("--delta", type=float, default=1e-9)
    p.add_argument("--max-rows", type=int, default=MAX_ROWS)
    p.add_argument("--max-cells", type=int, default=files.COPY_CELLS)
    p.add_argument("--print-limit", type=int, default=10, help="rows to print; 0 for none")
    p.add_argument("--sweep", type=int, nargs="+", metavar="THREADS", help="with --bench: once for each number of local threads, with seconds in ratio to native")
    p.add_argument("--expected", type=int, help="fail unless the join has so many rows")
    p.add_argument("--threads", type=int, help="local threads; without it the running session or master is used")
    return p


def _tree(spark, a: argparse.Namespace):
    if a.sample:
        return workloads.sample(spark)
    if a.tree:
        return files.read_tree(spark, a.tree)
    if a.workload:
        return files.read_product_profit(spark, a.workload[1]) if a.workload[0] == "tpch9" else files.read_workload(spark, *a.workload)
    return BUILT_IN[a.tables[0]](spark, a.tables[1])


def main(argv: Sequence[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if a.policy == "public" and a.target <= 0:
        p.error("--policy public needs a positive --target")
    if a.policy == "simulation" and a.target:
        p.error("--policy simulation makes its own target")
    if a.policy is None and a.target:
        p.error("--target needs --policy")
    if a.bench and (a.summary or a.policy):
        p.error("--bench goes alone")
    if a.sweep and not a.bench:
        p.error("--sweep needs --bench")
    strategies = STRATEGIES if a.strategy == "all" else (a.strategy,)
    for n in a.sweep or ():
        spark = session(n)
        got = profile_tree(_tree(spark, a), strategies)
        print(json.dumps({"threads": n, "rows": got.rows, "seconds": got.seconds, "to_native": {s: round(got.ratio(s, "native"), 2) for s in strategies} if "native" in strategies else None}))
        spark.stop()
    if a.sweep:
        return 0
    spark = session(a.threads)
    tree = _tree(spark, a)
    if a.bench:
        got = profile_tree(tree, strategies)
        print(json.dumps({"rows": got.rows, "seconds": got.seconds}))
        return 0
    if a.size:
        print(json.dumps({"output_rows": count_output(tree), "padded": padded_size(tree, a.epsilon, a.delta).target if a.policy == "simulation" else None}))
        return 0
    counts = set()
    for s in strategies:
        if a.policy:
            target = select_target(tree, a.policy, a.target, a.epsilon, a.delta, a.max_rows)
            df = materialize(tree, target.rows, s)
            if not may_copy_out(target):
                print(json.dumps({"strategy": s, "rows": target.rows, "columns": len(df.columns)}))
                continue
        else:
            df = evaluate(tree, s, max_rows=a.max_rows)
        if a.explain:
            print(plan_text(df))
        rows, columns = files.summary(df)
        counts.add(rows)
        print(json.dumps({"strategy": s, "rows": rows, "columns": columns}))
        if not a.summary:
            for row in files.first_rows(df, a.print_limit):
                print(*row)
    if len(counts) > 1 or (a.expected is not None and counts != {a.expected}):
        print("row counts differ", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
