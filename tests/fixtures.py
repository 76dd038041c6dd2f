"""Small trees as arrays (tables, parent, column in parent, column in child), and the exhaustive join they are checked against."""

import itertools
import random
from collections import Counter

BIG, SMALL = 2**31 - 1, -(2**31)

CASES = {
    "sample": ([[(15, 10, 3), (8, 7, 5), (9, 10, 1), (8, 9, 3)], [(10, 8), (11, 9), (12, 8), (13, 15)], [(7, 15), (7, 16), (10, 17), (9, 18)], [(1, 1), (3, 4), (3, 2), (5, 1)], [(1, 1), (3, 2), (3, 3), (1, 4)], [(1, 5), (2, 6), (4, 7), (4, 8)]], [-1, 0, 0, 0, 3, 3], [-1, 0, 1, 2, 0, 1], [-1, 1, 0, 0, 0, 0]),
    "two_branches": ([[(1, 10), (1, 11), (2, 20)], [(1, 100), (1, 101), (2, 200)], [(1, 300), (2, 400), (2, 401)], [(100, 1000), (100, 1001), (101, 1010), (200, 2000)]], [-1, 0, 0, 1], [-1, 0, 0, 1], [-1, 0, 0, 0]),
    "snowflake": ([[(1, 10, 100), (2, 20, 200)], [(7, 1), (8, 1), (9, 2)], [(10, 5), (20, 6)], [(100, 3), (200, 4)], [(100, 11), (200, 12)], [(3, 21), (4, 22)]], [-1, 0, 0, 0, 3, 3], [-1, 0, 1, 2, 0, 1], [-1, 1, 0, 0, 0, 0]),
    "inherited_stride": ([[(1, 2)], [(1, 3)], [(3, 4)], [(4, 40), (4, 41)], [(2, 20), (2, 21)]], [-1, 0, 1, 2, 0], [-1, 0, 1, 1, 1], [-1, 0, 0, 0, 0]),
    "dangling": ([[(0, 10), (1, 11), (2, 12), (3, 13)], [(2, 20)]], [-1, 0], [-1, 0], [-1, 0]),
    "extreme_keys": ([[(SMALL, 1), (BIG, 2), (0, 3)], [(SMALL, 4), (BIG, 5), (0, 6)]], [-1, 0], [-1, 0], [-1, 0]),
    "no_match": ([[(1, 10)], [(2, 20)]], [-1, 0], [-1, 0], [-1, 0]),
    "empty_root": ([[], [(1, 1)]], [-1, 0], [-1, 0], [-1, 0]),
    "empty_child": ([[(1, 1)], []], [-1, 0], [-1, 0], [-1, 0]),
    "empty_inner": ([[(1, 1)], [], [(1, 1)]], [-1, 0, 1], [-1, 0, 0], [-1, 0, 0]),
    "single": ([[(1, 10), (2, 20)]], [-1], [-1], [-1]),
    "single_empty": ([[]], [-1], [-1], [-1]),
    "root_is_second": ([[(1, 10), (2, 20)], [(1, 30), (1, 40)]], [1, -1], [0, -1], [0, -1]),
    "depth_two": ([[(1, 2)] * 1 + [(3, 4)], [(1, 5, 6), (3, 7, 8)], [(2, 9, 10), (4, 11, 12)], [(5, 1), (7, 2)], [(6, 1), (8, 2)], [(9, 1), (11, 2)], [(10, 1), (12, 2)]], [-1, 0, 0, 1, 1, 2, 2], [-1, 0, 1, 1, 2, 1, 2], [-1, 0, 0, 0, 0, 0, 0]),
    "repeated_rows": ([[(1, 1), (1, 1), (2, 2)], [(1, 9), (1, 9)], [(1, 7), (2, 7), (2, 7)]], [-1, 0, 0], [-1, 0, 1], [-1, 0, 0]),
}


def random_case(seed: int):
    r = random.Random(seed)
    n = r.randint(2, 5)
    tables = [[(r.randint(0, 2), r.randint(0, 2)) for _ in range(r.randint(1, 3))] for _ in range(n)]
    parent = [-1] + [r.randrange(i) for i in range(1, n)]
    return tables, parent, [-1] + [1] * (n - 1), [-1] + [0] * (n - 1)


def brute(tables, parent, jp, jc) -> Counter:
    out = Counter()
    for rows in itertools.product(*tables):
        if all(p < 0 or (rows[p][jp[c]] is not None and rows[p][jp[c]] == rows[c][jc[c]]) for c, p in enumerate(parent)):
            out[tuple(x for row in rows for x in row)] += 1
    return out


def frames(spark, tables):
    """Literal rows, which need no Python workers."""
    out = []
    for t in tables:
        width = len(t[0]) if t else 2
        columns = ", ".join(f"CAST(c{i} AS BIGINT) AS c{i}" for i in range(width))
        rows = ", ".join("(" + ", ".join("NULL" if x is None else str(x) for x in r) + ")" for r in t or [(0,) * width])
        out.append(spark.sql(f"SELECT {columns} FROM VALUES {rows} AS t({', '.join(f'c{i}' for i in range(width))})" + ("" if t else " WHERE false")))
    return out


def bag(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())
