"""Readers and writers of workload files, and result sinks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.tree import InvalidTree, JoinTree, OutputTooLarge, from_arrays

COPY_CELLS = 1_000_000  #: cells that copy_out hands over, unless said otherwise


def read_ints(spark: SparkSession, path: str, columns: Sequence[str] | int | None = None) -> DataFrame:
    """Whitespace-separated whole numbers, a row a line; blank lines are skipped. columns: names, or how many (then c0, c1, ...), or as many as the first line has.

    A value that is no number is an error where it is read.
    """
    lines = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("v")).filter(F.col("v")[0] != "")
    if columns is None:
        first = lines.first()
        columns = len(first.v) if first else 0
    names = [f"c{i}" for i in range(columns)] if isinstance(columns, int) else list(columns)
    return lines.select(*[F.get("v", F.lit(i)).cast("long").alias(n) for i, n in enumerate(names)], F.size("v").alias("__width"))


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | int) -> DataFrame:
    """As read_ints; an empty file, or a row of another width, is an error."""
    df = read_ints(spark, path, columns)
    width = columns if isinstance(columns, int) else len(columns)
    facts = df.agg(F.count("*").alias("n"), F.count_if(F.col("__width") != width).alias("bad")).first()
    if not facts.n:
        raise ValueError(f"{path} is empty")
    if facts.bad:
        raise ValueError(f"{facts.bad} rows of {path} don't have {width} columns")
    return df.drop("__width")


def read_expected(spark: SparkSession, path: str) -> int:
    return read_table(spark, path, 1).first()[0]


def read_stats(spark: SparkSession, path: str) -> dict[str, str]:
    """key=value lines; a file of a few lines."""
    return dict(r.value.split("=", 1) for r in spark.read.text(path).filter(F.col("value").contains("=")).collect())


def read_tree(spark: SparkSession, folder: str) -> JoinTree:
    """tree.txt (id parent parent_column child_column width) and tables.tbl (relation value ...) of a folder, checked."""
    rows = sorted(read_table(spark, f"{folder}/tree.txt", ["id", "parent", "jp", "jc", "width"]).collect())  # one row for each relation
    if [r.id for r in rows] != list(range(len(rows))):
        raise InvalidTree("relation ids are not 0, 1, ...")
    if any((r.parent == -1) != (r.jp == -1 and r.jc == -1) or r.width < 1 for r in rows):
        raise InvalidTree("only the root has no join columns, and every relation has columns")
    widths = {r.id: r.width for r in rows}
    lines = spark.read.text(f"{folder}/tables.tbl").select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("v")).filter(F.col("v")[0] != "")
    values = lines.select(F.col("v")[0].cast("int").alias("r"), F.size("v").alias("n"), "v")
    expected = F.element_at(F.create_map(*[F.lit(x) for r, w in widths.items() for x in (r, w + 1)]), F.col("r"))
    counts = {x.r: x for x in values.groupBy("r").agg(F.count("*").alias("n"), F.count_if(F.col("n") != expected).alias("bad")).collect()}
    if set(counts) != set(widths) or any(x.bad for x in counts.values()):
        raise InvalidTree("a relation has no rows, or rows of another width or relation number")
    tables = [values.filter(F.col("r") == r).select(*[F.col("v")[i + 1].cast("long").alias(f"c{i}") for i in range(w)]) for r, w in widths.items()]
    return from_arrays(tables, [r.parent for r in rows], [r.jp for r in rows], [r.jc for r in rows], [r.width for r in rows])


# The workload folders' files with their widths, and the trees over them (parent; column in parent; column in child).
WORKLOADS: dict[str, tuple[dict[str, int], list[int], list[int], list[int]]] = {
    "q18": ({"R1_catalog_sales.tbl": 4, "R2_date_dim.tbl": 2, "R3_item.tbl": 2, "R4_cd1.tbl": 2, "R5_customer.tbl": 3, "R6_cd2.tbl": 2, "R7_customer_address.tbl": 2}, [-1, 0, 0, 0, 0, 4, 4], [-1, 0, 1, 2, 3, 1, 2], [-1, 0, 0, 0, 0, 0, 0]),
    "q85": ({"R1_web_sales.tbl": 3, "R2_web_page.tbl": 2, "R3_date_dim.tbl": 2, "R4_web_returns.tbl": 5, "R5_cd1.tbl": 2, "R6_cd2.tbl": 2, "R7_customer_address.tbl": 2, "R8_reason.tbl": 2}, [-1, 0, 0, 0, 3, 3, 3, 3], [-1, 0, 1, 2, 1, 2, 3, 4], [-1, 0, 0, 0, 0, 0, 0, 0]),
    "q85_chain": ({"R1_web_sales.tbl": 2, "R2_web_returns.tbl": 2, "R3_cd1.tbl": 2}, [-1, 0, 1], [-1, 0, 1], [-1, 0, 0]),
    "q85_star": ({"R1_web_returns.tbl": 4, "R2_cd1.tbl": 2, "R3_cd2.tbl": 2, "R4_customer_address.tbl": 2, "R5_reason.tbl": 2}, [-1, 0, 0, 0, 0], [-1, 0, 1, 2, 3], [-1, 0, 0, 0, 0]),
    "job1a": ({"R1_movie_companies.tbl": 2, "R2_company_type.tbl": 1, "R3_title.tbl": 1, "R4_movie_info_idx.tbl": 2, "R5_info_type.tbl": 1}, [-1, 0, 0, 0, 3], [-1, 0, 1, 1, 1], [-1, 0, 0, 0, 0]),
}
# The files of the nine-relation and the product-profit workloads.
TPCH9_FILES = {"lineitem": ("lineitem_sk_pk_ok.txt", ["suppkey", "partkey", "orderkey"]), "orders": ("orders_ok.txt", ["orderkey"]), "partsupp": ("partsupp.txt", ["partkey", "suppkey"]), "part": ("part.txt", ["partkey"]), "supplier": ("supplier_sk_nk.txt", ["suppkey", "nationkey"]), "nation": ("nation.txt", ["nationkey"])}


def read_workload(spark: SparkSession, name: str, folder: str) -> JoinTree:
    files, parent, jp, jc = WORKLOADS[name]
    return from_arrays([read_table(spark, f"{folder}/{f}", w) for f, w in files.items()], parent, jp, jc, list(files.values()))


def read_product_profit(spark: SparkSession, folder: str) -> JoinTree:
    """The six-relation tree below lineitem. The part-supplier key stays two columns: Spark joins on both."""
    from ..plans.tree import edge

    tables = {name: read_table(spark, f"{folder}/{file}", columns) for name, (file, columns) in TPCH9_FILES.items()}
    return JoinTree(tables, [edge("orders", "lineitem", "orderkey"), edge("partsupp", "lineitem", ["partkey", "suppkey"]), edge("part", "partsupp", "partkey"), edge("supplier", "partsupp", "suppkey"), edge("nation", "supplier", "nationkey")], "lineitem")


def _fields(columns: Mapping[str, str]) -> T.StructType:
    return T.StructType([T.StructField(c, T._parse_datatype_string(t)) for c, t in columns.items()])


def read_bars(spark: SparkSession, path: str, columns: Mapping[str, str], empty_as_zero: bool = False) -> DataFrame:
    """`|`-separated rows that may end in a separator. Empty fields are null, or 0 in numeric columns if empty_as_zero (then 0 joins as a value).

    A row of another width, or a value that isn't of its column's type, is an error where it is read.
    """
    n = len(columns)
    parts = spark.read.text(path).filter("value <> ''").select(F.split("value", r"\|", -1).alias("v"))
    fits = (F.size("v") == n) | ((F.size("v") == n + 1) & (F.get("v", F.lit(n)) == ""))
    checked = parts.select(F.when(fits, F.col("v")).otherwise(F.raise_error(F.concat(F.lit(f"a row doesn't have {n} fields: "), F.concat_ws("|", "v")))).alias("v"))
    df = checked.select(*[F.nullif(F.get("v", F.lit(i)), F.lit("")).cast(t).alias(c) for i, (c, t) in enumerate(columns.items())])
    return df.fillna(0) if empty_as_zero else df


def read_quoted_csv(spark: SparkSession, path: str, columns: Mapping[str, str], line_breaks: bool = False) -> DataFrame:
    """Comma-separated, quoted by \", escaped by a backslash; gzipped files are read as they are. With line_breaks fields may hold some; then a file is one task."""
    return spark.read.csv(path, sep=",", quote='"', escape="\\", multiLine=line_breaks, schema=_fields(columns))


def unpack(spark: SparkSession, archive: str, folder: str) -> list[str]:
    """Files of a .tar or .tgz that the driver can open, each gzipped into a shared folder under its own name; their paths.

    An archive can't be split, so it is streamed once, block by block; members are read in parallel from then on.
    """
    import gzip
    import tarfile

    class Out:
        def __init__(self, path: str):
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            self.stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)

        def write(self, data) -> int:
            self.stream.write(bytearray(data))
            return len(data)

        def flush(self) -> None:
            self.stream.flush()

    out = []
    with tarfile.open(archive, "r|*") as members:
        for m in members:
            if not m.isfile():
                continue
            path = f"{folder}/{m.name.rsplit('/', 1)[-1]}.gz"
            if path in out:
                raise ValueError(f"two files of {archive} have the name of {path}")
            raw = Out(path)
            with gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) as packed:
                source = members.extractfile(m)
                while block := source.read(1 << 20):
                    packed.write(block)
            raw.stream.close()
            out.append(path)
    return out


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """source, target of an edge list; lines that start with # are comments."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).filter((F.col("v") != "") & ~F.col("v").startswith("#"))
    parts = F.split("v", r"\s+")
    return lines.select(parts[0].cast("long").alias("source"), parts[1].cast("long").alias("target"))


def project(df: DataFrame, columns: Sequence[str | Column], limit: int | None = None) -> DataFrame:
    """Columns of the rows in which none of them is null; at most limit rows."""
    out = df.select(*columns).dropna()
    return out if limit is None else out.limit(limit)


def write_ints(df: DataFrame, path: str, sep: str = " ") -> None:
    df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in df.columns]).alias("value")).write.mode("overwrite").text(path)


def write_tree(tree: JoinTree, folder: str, expected: int | None = None, stats: Mapping[str, object] | None = None) -> None:
    """tree.txt, tables.tbl, and where given expected.txt and stats.txt, as folders of text parts. Keys are one column each."""
    spark = tree.relations[tree.root].sparkSession
    number = {r: i for i, r in enumerate(tree.relations)}
    lines = []
    for r, i in number.items():
        if r == tree.root:
            lines.append(f"{i} -1 -1 -1 {len(tree.relations[r].columns)}")
        else:
            e = tree.edge_to(r)
            if len(e.child_columns) != 1:
                raise ValueError("this format has one key column for an edge")
            lines.append(f"{i} {number[e.parent]} {tree.relations[e.parent].columns.index(e.parent_columns[0])} {tree.relations[r].columns.index(e.child_columns[0])} {len(tree.relations[r].columns)}")
    _write_lines(spark, lines, f"{folder}/tree.txt")
    rows = None
    for r, i in number.items():
        df = tree.relations[r]
        one = df.select(F.concat_ws(" ", F.lit(str(i)), *[F.col(c).cast("string") for c in df.columns]).alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    rows.write.mode("overwrite").text(f"{folder}/tables.tbl")
    if expected is not None:
        _write_lines(spark, [str(expected)], f"{folder}/expected.txt")
    if stats is not None:
        _write_lines(spark, [f"{k}={v}" for k, v in stats.items()], f"{folder}/stats.txt")


def write_suite(spark: SparkSession, rows: Iterable[Mapping[str, object]], path: str) -> None:
    """A summary table, one row a case, with a header."""
    rows = list(rows)
    spark.createDataFrame([{k: str(v) for k, v in r.items()} for r in rows]).select(*rows[0]).coalesce(1).write.mode("overwrite").csv(path, header=True)


def _write_lines(spark: SparkSession, lines: list[str], path: str) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def copy_out(df: DataFrame, max_cells: int = COPY_CELLS) -> list:
    """The rows, if they have at most max_cells cells. No more than one row beyond is ever fetched."""
    most = max_cells // max(1, len(df.columns))
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise OutputTooLarge(df.count(), most)
    return rows


def summary(df: DataFrame) -> tuple[int, int]:
    """Rows and columns."""
    return df.count(), len(df.columns)


def first_rows(df: DataFrame, n: int) -> list:
    return df.take(n) if n > 0 else []


def run_only(df: DataFrame) -> None:
    """Makes every row and keeps none."""
    df.write.format("noop").mode("overwrite").save()
