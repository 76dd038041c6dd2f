"""Join trees over the TPC-H-like tables: star, chain, snowflake, self-joins, many-to-many, and the shapes of the benchmark workloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import in_sample, like_filter
from .tree import JoinTree, edge, from_arrays

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _long(df: DataFrame, *columns: str) -> DataFrame:
    """Key columns as long: the tables mix 32- and 64-bit keys."""
    return df.select(*[F.col(c).cast("long").alias(c) for c in columns])


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return _long(load(spark, folder, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def part_suppliers(spark: SparkSession, folder: str) -> DataFrame:
    """The (part, supplier) pairs that occur in lineitem, which stand for a table of them."""
    return _long(load(spark, folder, "lineitem"), "l_partkey", "l_suppkey").distinct().withColumnsRenamed({"l_partkey": "ps_partkey", "l_suppkey": "ps_suppkey"})


def product_profit(spark: SparkSession, folder: str, name_part: str | None = None) -> JoinTree:
    """lineitem over orders and partsupp; partsupp over part and supplier; supplier over nation. name_part keeps parts whose name has it."""
    part = load(spark, folder, "part")
    part = part if name_part is None else part.filter(like_filter(F.col("p_name"), [name_part]))
    return JoinTree(
        {
            "lineitem": lines(spark, folder), "orders": _long(load(spark, folder, "orders"), "o_orderkey"), "partsupp": part_suppliers(spark, folder),
            "part": _long(part, "p_partkey"), "supplier": _long(load(spark, folder, "supplier"), "s_suppkey", "s_nationkey"), "nation": _long(load(spark, folder, "nation"), "n_nationkey"),
        },
        [edge("orders", "lineitem", "o_orderkey", "l_orderkey"), edge("partsupp", "lineitem", ["ps_partkey", "ps_suppkey"], ["l_partkey", "l_suppkey"]), edge("part", "partsupp", "p_partkey", "ps_partkey"), edge("supplier", "partsupp", "s_suppkey", "ps_suppkey"), edge("nation", "supplier", "n_nationkey", "s_nationkey")],
        "lineitem",
    )


def chain(spark: SparkSession, folder: str) -> JoinTree:
    """customer, orders, lineitem."""
    return JoinTree(
        {"customer": _long(load(spark, folder, "customer"), "c_custkey", "c_nationkey"), "orders": _long(load(spark, folder, "orders"), "o_orderkey", "o_custkey"), "lineitem": lines(spark, folder)},
        [edge("orders", "customer", "o_custkey", "c_custkey"), edge("lineitem", "orders", "l_orderkey", "o_orderkey")],
        "customer",
    )


def star(spark: SparkSession, folder: str) -> JoinTree:
    """lineitem over orders, part and supplier."""
    return JoinTree(
        {"lineitem": lines(spark, folder), "orders": _long(load(spark, folder, "orders"), "o_orderkey", "o_custkey"), "part": _long(load(spark, folder, "part"), "p_partkey", "p_size"), "supplier": _long(load(spark, folder, "supplier"), "s_suppkey", "s_nationkey")},
        [edge("orders", "lineitem", "o_orderkey", "l_orderkey"), edge("part", "lineitem", "p_partkey", "l_partkey"), edge("supplier", "lineitem", "s_suppkey", "l_suppkey")],
        "lineitem",
    )


def snowflake(spark: SparkSession, folder: str) -> JoinTree:
    """lineitem, orders, customer, nation, region."""
    return JoinTree(
        {"lineitem": lines(spark, folder), "orders": _long(load(spark, folder, "orders"), "o_orderkey", "o_custkey"), "customer": _long(load(spark, folder, "customer"), "c_custkey", "c_nationkey"), "nation": _long(load(spark, folder, "nation"), "n_nationkey", "n_regionkey"), "region": _long(load(spark, folder, "region"), "r_regionkey")},
        [edge("orders", "lineitem", "o_orderkey", "l_orderkey"), edge("customer", "orders", "c_custkey", "o_custkey"), edge("nation", "customer", "n_nationkey", "c_nationkey"), edge("region", "nation", "r_regionkey", "n_regionkey")],
        "lineitem",
    )


def many_to_many(spark: SparkSession, folder: str, sides: int = 1) -> JoinTree:
    """customer over its orders and, once or twice, its events: matches multiply."""
    events = load(spark, folder, "events")
    relations = {"customer": _long(load(spark, folder, "customer"), "c_custkey"), "orders": _long(load(spark, folder, "orders"), "o_orderkey", "o_custkey")}
    edges = [edge("orders", "customer", "o_custkey", "c_custkey")]
    for i in range(sides):
        relations[f"events{i}"] = events.select(F.col("event_id").alias(f"e{i}_id"), F.col("user_id").alias(f"e{i}_user"))
        edges.append(edge(f"events{i}", "customer", f"e{i}_user", "c_custkey"))
    return JoinTree(relations, edges, "customer")


def same_dimension_twice(spark: SparkSession, folder: str) -> JoinTree:
    """lineitem over supplier and orders; both sides end in nation, under two names."""
    nation = load(spark, folder, "nation")
    twice = lambda p: nation.select(F.col("n_nationkey").cast("long").alias(f"{p}_nationkey"), F.col("n_name").alias(f"{p}_nation"))
    return JoinTree(
        {"lineitem": lines(spark, folder), "supplier": _long(load(spark, folder, "supplier"), "s_suppkey", "s_nationkey"), "supplier_nation": twice("sn"), "orders": _long(load(spark, folder, "orders"), "o_orderkey", "o_custkey"), "customer": _long(load(spark, folder, "customer"), "c_custkey", "c_nationkey"), "customer_nation": twice("cn")},
        [edge("supplier", "lineitem", "s_suppkey", "l_suppkey"), edge("supplier_nation", "supplier", "sn_nationkey", "s_nationkey"), edge("orders", "lineitem", "o_orderkey", "l_orderkey"), edge("customer", "orders", "c_custkey", "o_custkey"), edge("customer_nation", "customer", "cn_nationkey", "c_nationkey")],
        "lineitem",
    )


def catalog_shape(spark: SparkSession, folder: str) -> JoinTree:
    """Seven relations: a fact over date, item, demographics and customer; customer over demographics again and address.

    Dates are order months, items parts, demographics order statuses and market segments, addresses nations.
    """
    orders, customer, part, nation = (load(spark, folder, t) for t in ("orders", "customer", "part", "nation"))
    months = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    sales = load(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(months.cast("long").alias("sold_month"), F.col("l_partkey").alias("item"), F.col("o_orderstatus").alias("bill_status"), F.col("o_custkey").alias("bill_customer"))
    dim = lambda df, c, name: df.select(F.col(c).alias(name)).distinct()
    return JoinTree(
        {
            "sales": sales, "month": orders.select(months.cast("long").alias("month")).distinct(), "item": part.select(F.col("p_partkey").alias("i_item"), F.col("p_size").alias("i_size")), "status": dim(orders, "o_orderstatus", "status"),
            "customer": customer.select(F.col("c_custkey").alias("c_customer"), F.col("c_mktsegment").alias("c_segment"), F.col("c_nationkey").alias("c_nation")), "segment": dim(customer, "c_mktsegment", "segment"), "address": nation.select(F.col("n_nationkey").alias("a_nation"), F.col("n_regionkey").alias("a_region")),
        },
        [edge("month", "sales", "month", "sold_month"), edge("item", "sales", "i_item", "item"), edge("status", "sales", "status", "bill_status"), edge("customer", "sales", "c_customer", "bill_customer"), edge("segment", "customer", "segment", "c_segment"), edge("address", "customer", "a_nation", "c_nation")],
        "sales",
    )


def returns_shape(spark: SparkSession, folder: str) -> JoinTree:
    """Eight relations: sales over page, date and, by a composite key, returns; returns over two demographics, address and reason.

    Returned lines are those flagged R; pages are line numbers, demographics nations of customer and supplier, reasons line statuses.
    """
    line, orders, customer, supplier, nation = (load(spark, folder, t) for t in ("lineitem", "orders", "customer", "supplier", "nation"))
    sales = line.select(F.col("l_linenumber").alias("page"), F.year("l_shipdate").alias("year"), F.col("l_orderkey").alias("s_order"), F.col("l_partkey").alias("s_part"))
    back = line.filter("l_returnflag = 'R'").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    returns = back.select(F.col("l_orderkey").alias("r_order"), F.col("l_partkey").alias("r_part"), F.col("c_nationkey").alias("refunded"), F.col("s_nationkey").alias("returning"), F.col("o_orderstatus").alias("r_status"), F.col("l_linestatus").alias("r_reason"))
    dim = lambda df, c, name: df.select(F.col(c).alias(name)).distinct()
    return JoinTree(
        {
            "sales": sales, "page": dim(line, "l_linenumber", "p_page"), "year": line.select(F.year("l_shipdate").alias("y_year")).distinct(), "returns": returns,
            "refunded": dim(nation, "n_nationkey", "d1"), "returning": dim(nation, "n_nationkey", "d2"), "status": dim(orders, "o_orderstatus", "status"), "reason": dim(line, "l_linestatus", "reason"),
        },
        [edge("page", "sales", "p_page", "page"), edge("year", "sales", "y_year", "year"), edge("returns", "sales", ["r_order", "r_part"], ["s_order", "s_part"]), edge("refunded", "returns", "d1", "refunded"), edge("returning", "returns", "d2", "returning"), edge("status", "returns", "status", "r_status"), edge("reason", "returns", "reason", "r_reason")],
        "sales",
    )


def sampled_chain(spark: SparkSession, folder: str, percent: int) -> JoinTree:
    """The chain below a nested sample of customers, which its orders and their lines follow."""
    tree = chain(spark, folder)
    customer = tree.relations["customer"].filter(in_sample(F.col("c_custkey"), percent))
    orders = tree.relations["orders"].join(customer, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    line = tree.relations["lineitem"].join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return tree.with_relations({"customer": customer, "orders": orders, "lineitem": line})


# What the movie workload's dimensions are filtered by.
MOVIE_KIND, MOVIE_COUNTRY, MOVIE_COMPANY, MOVIE_RELEASE, MOVIE_RATING = "movie", "[us]", "production companies", "release dates", "rating"


# The six small relations of the sample, with parents and join columns.
SAMPLE = ([[(15, 10, 3), (8, 7, 5), (9, 10, 1), (8, 9, 3)], [(10, 8), (11, 9), (12, 8), (13, 15)], [(7, 15), (7, 16), (10, 17), (9, 18)], [(1, 1), (3, 4), (3, 2), (5, 1)], [(1, 1), (3, 2), (3, 3), (1, 4)], [(1, 5), (2, 6), (4, 7), (4, 8)]], [-1, 0, 0, 0, 3, 3], [-1, 0, 1, 2, 0, 1], [-1, 1, 0, 0, 0, 0])


def sample(spark: SparkSession) -> JoinTree:
    """A tree of six relations with 20 output rows, to try the command line with."""
    tables, parent, jp, jc = SAMPLE
    return from_arrays([spark.createDataFrame(t, ", ".join(f"c{i} long" for i in range(len(t[0])))) for t in tables], parent, jp, jc)


def movie_release(title: DataFrame, kind_type: DataFrame, movie_companies: DataFrame, company_name: DataFrame, company_type: DataFrame, movie_info: DataFrame, movie_info_idx: DataFrame, info_type: DataFrame, percent: int = 100) -> JoinTree:
    """Nine relations below title: its kind, companies (over name and type), infos and rating infos (each over its info type).

    title (id, kind_id); movie_companies (movie_id, company_id, company_type_id); movie_info and movie_info_idx (movie_id, info_type_id);
    kind_type (id, kind), company_name (id, country_code), company_type (id, kind) and info_type (id, info). percent takes a nested
    sample of titles, which all facts follow; rows with null keys are kept and never match.
    """
    if not 1 <= percent <= 100:
        raise ValueError("a sample has 1 to 100 percent")
    kept = lambda df, c: df if percent == 100 else df.filter(in_sample(F.col(c), percent))
    ids = lambda df, c, value, name: df.filter(F.col(c) == value).select(F.col("id").alias(name))
    facts = lambda df, p: kept(df, "movie_id").join(kept(title, "id").select(F.col("id").alias("movie_id")).distinct(), "movie_id", "left_semi").withColumnsRenamed({c: f"{p}_{c}" for c in df.columns})
    return JoinTree(
        {
            "title": kept(title, "id").select("id", "kind_id"), "kind_type": ids(kind_type, "kind", MOVIE_KIND, "kt_id"),
            "movie_companies": facts(movie_companies.select("movie_id", "company_id", "company_type_id"), "mc"), "company_name": ids(company_name, "country_code", MOVIE_COUNTRY, "cn_id"), "company_type": ids(company_type, "kind", MOVIE_COMPANY, "ct_id"),
            "movie_info": facts(movie_info.select("movie_id", "info_type_id"), "mi"), "release_type": ids(info_type, "info", MOVIE_RELEASE, "it_id"),
            "movie_info_idx": facts(movie_info_idx.select("movie_id", "info_type_id"), "mx"), "rating_type": ids(info_type, "info", MOVIE_RATING, "ix_id"),
        },
        [edge("kind_type", "title", "kt_id", "kind_id"), edge("movie_companies", "title", "mc_movie_id", "id"), edge("company_name", "movie_companies", "cn_id", "mc_company_id"), edge("company_type", "movie_companies", "ct_id", "mc_company_type_id"), edge("movie_info", "title", "mi_movie_id", "id"), edge("release_type", "movie_info", "it_id", "mi_info_type_id"), edge("movie_info_idx", "title", "mx_movie_id", "id"), edge("rating_type", "movie_info_idx", "ix_id", "mx_info_type_id")],
        "title",
    )


SCALES = (20, 40, 60, 80, 100)  #: percent of the titles in the nested series


def supply_movies(spark: SparkSession, folder: str, percent: int = 100) -> JoinTree:
    """movie_release over the test tables: titles are orders, companies suppliers, infos lines; nations, by region, are the types."""
    order, line, nation = load(spark, folder, "orders"), load(spark, folder, "lineitem"), load(spark, folder, "nation")
    either = lambda c, one, value, other: F.when(F.col(c) == one, F.lit(value)).otherwise(F.lit(other))
    movie = F.col("l_orderkey").alias("movie_id")
    return movie_release(
        order.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("kind_id")),
        _long(load(spark, folder, "region"), "r_regionkey").select(F.col("r_regionkey").alias("id"), either("r_regionkey", 1, "series", MOVIE_KIND).alias("kind")),
        line.select(movie, F.col("l_suppkey").alias("company_id"), F.col("l_linenumber").alias("company_type_id")),
        load(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") < 18, F.lit(MOVIE_COUNTRY)).otherwise(F.lit("[de]")).alias("country_code")),
        nation.select(F.col("n_nationkey").alias("id"), either("n_regionkey", 1, "distributors", MOVIE_COMPANY).alias("kind")),
        line.select(movie, F.col("l_linenumber").alias("info_type_id")), line.select(movie, (F.col("l_partkey") % 25).alias("info_type_id")),
        nation.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") == 1, F.lit(MOVIE_RELEASE)).when(F.col("n_regionkey") == 2, F.lit(MOVIE_RATING)).otherwise(F.lit("budget")).alias("info")),
        percent,
    )


def supply_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between suppliers of one order: from a line's supplier to that of the order's next line."""
    line = load(spark, folder, "lineitem")
    a = line.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("source"))
    b = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("target"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).filter("source <> target").select("source", "target").distinct()


def two_step_walks(spark: SparkSession, folder: str) -> JoinTree:
    """Three aliases of the supply graph, each starting where the one before ends."""
    e = supply_graph(spark, folder)
    rel = lambda i: e.select(F.col("source").alias(f"v{i}"), F.col("target").alias(f"w{i}"))
    return JoinTree({"first": rel(0), "second": rel(1), "third": rel(2)}, [edge("second", "first", "v1", "w0"), edge("third", "second", "v2", "w1")], "first")
