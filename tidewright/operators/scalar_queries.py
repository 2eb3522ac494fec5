"""Queries of the scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..plans.registry import query
from ..sources.tables import iso, ordered_scan, table


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, p_size, CAST(p_retailprice AS VARCHAR) AS p_retailprice FROM part")
def scan_ordered_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_scan(table(spark, sf_dir, "part"), as_text=("p_partkey", "p_retailprice"))


@query("SELECT o_orderkey, lower(hex(encode(o_orderpriority))) AS priority_hex, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS order_iso FROM orders")
def binary_hex_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", F.lower(F.hex(F.encode("o_orderpriority", "UTF-8"))).alias("priority_hex"), iso(F.col("o_orderdate"), orders.schema["o_orderdate"].dataType).alias("order_iso"))


@query("SELECT doc_id, lower(CASE WHEN regexp_matches(source || '-' || lang || '.' || doc_id, '^[0-9]') THEN 'f_' ELSE '' END || regexp_replace(source || '-' || lang || '.' || doc_id, '[^A-Za-z0-9_]', '_', 'g')) AS name, 'f_' || doc_id || '_' || lang AS digit_name FROM documents")
def sanitize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", s.sanitized(F.concat_ws("", "source", F.lit("-"), "lang", F.lit("."), F.col("doc_id").cast("string"))).alias("name"), s.sanitized(F.concat_ws(" ", F.col("doc_id").cast("string"), "lang")).alias("digit_name"))


@query("SELECT o_orderkey, CASE o_orderkey % 8 WHEN 1 THEN 'In process' WHEN 2 THEN 'Approved' WHEN 3 THEN 'Backordered' WHEN 4 THEN 'Rejected' WHEN 5 THEN 'Shipped' WHEN 6 THEN 'Cancelled' ELSE '** Invalid **' END AS status FROM orders")
def status_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", s.status_text(F.col("o_orderkey") % 8, s.SALES_ORDER_STATUS).alias("status"))


@query("SELECT o_orderkey, 'AW' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS account, printf('%08d', o_custkey + 123456789) AS wide FROM orders")
def leading_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("AW"), s.leading_zeros(F.col("o_custkey"))).alias("account"), s.leading_zeros(F.col("o_custkey") + 123456789).alias("wide"))


@query("SELECT c_custkey, replace(c_name, '#', ' ') || ' ' || coalesce(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END, 'none') AS label, length(rtrim(c_name || '   ')) AS visible, trim('  ' || c_mktsegment || ' ') AS trimmed FROM customer")
def string_funcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    label = F.concat(F.replace("c_name", F.lit("#"), F.lit(" ")), F.lit(" "), F.coalesce(segment, F.lit("none")))
    padded = F.concat("c_name", F.lit("   "))
    return table(spark, sf_dir, "customer").select("c_custkey", label.alias("label"), s.visible_length(padded).cast("long").alias("visible"), F.trim(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("trimmed"))


@query("""SELECT o_orderkey, year(o_orderdate + INTERVAL 6 MONTH) AS fiscal_year, CAST(strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d') AS TIMESTAMP) AS day_112, date_trunc('day', o_orderdate) AS day_101,
make_timestamp(year(o_orderdate), 7, 1, 0, 0, 0) AS accounting_start, make_timestamp(year(o_orderdate) + 1, 7, 1, 0, 0, 0) - INTERVAL 2 MILLISECOND AS accounting_end FROM orders""")
def date_funcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    day, american = s.day_112(F.date_format("o_orderdate", "yyyyMMdd")), s.day_101(F.date_format("o_orderdate", "MM/dd/yyyy"))
    year = F.year("o_orderdate")
    return orders.select("o_orderkey", s.fiscal_year(F.col("o_orderdate")).alias("fiscal_year"), day.alias("day_112"), american.alias("day_101"), s.accounting_start(year).alias("accounting_start"), s.accounting_end(year).alias("accounting_end"))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)
SELECT doc_id, count(*) AS hits, count(DISTINCT word) AS terms FROM w WHERE word IN ('license', 'token', 'released', 'public') GROUP BY 1""")
def fulltext_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have any of the terms, by how often: terms are found before words are made rows."""
    wanted = ["license", "token", "released", "public"]
    found = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda w: w.isin(wanted))
    words = table(spark, sf_dir, "documents").select("doc_id", found.alias("w")).filter(F.size("w") > 0)
    return words.select("doc_id", F.size("w").cast("long").alias("hits"), F.size(F.array_distinct("w")).cast("long").alias("terms"))


#: Status texts, padded numbers and accounting dates as SQL functions; the texts are fixed values.
SQL_FUNCTIONS = {
    "document_status_text": "(status BIGINT) RETURNS STRING RETURN CASE status WHEN 1 THEN 'Pending approval' WHEN 2 THEN 'Approved' WHEN 3 THEN 'Obsolete' ELSE '** Invalid **' END",
    "leading_zeros": "(value BIGINT) RETURNS STRING RETURN CASE WHEN length(CAST(value AS STRING)) >= 8 THEN CAST(value AS STRING) ELSE lpad(CAST(value AS STRING), 8, '0') END",
    "accounting_start_date": "(y INT) RETURNS TIMESTAMP_NTZ RETURN CAST(make_date(y, 7, 1) AS TIMESTAMP_NTZ)",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Makes the SQL functions known to the session; Catalyst puts their bodies into the plan of a query that calls them."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return sorted(SQL_FUNCTIONS)


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'Pending approval' WHEN 2 THEN 'Approved' WHEN 3 THEN 'Obsolete' ELSE '** Invalid **' END AS status, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS account,
make_timestamp(year(o_orderdate), 7, 1, 0, 0, 0) AS starts FROM orders""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_functions(spark)
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", "document_status_text(o_orderkey % 4) AS status", "leading_zeros(o_custkey) AS account", "accounting_start_date(year(o_orderdate)) AS starts")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%e%' AND p_brand NOT LIKE 'Brand#1%'")
def like_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.filter(F.col("p_name").like("%a%e%") & ~F.col("p_brand").like("Brand#1%")).select("p_partkey", "p_name")


@query("SELECT doc_id, left(text, 20) AS head, left(CAST(n_chars AS VARCHAR), 2) AS digits, true AS past FROM documents")
def cut_varchar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values cut to a width; the current time lies after any given day."""
    past = F.current_timestamp() > F.lit("2020-01-01").cast("timestamp")
    return table(spark, sf_dir, "documents").select("doc_id", s.cut_text(F.col("text"), 20).alias("head"), s.cut_text(F.col("n_chars"), 2).alias("digits"), past.alias("past"))


@query("""SELECT p_partkey, p_brand, n_parts FROM part JOIN (SELECT '/' || p_brand || '/' AS path, count(*) AS n_parts FROM part GROUP BY 1) b ON '/' || p_brand || '/' = b.path""")
def computed_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes joined with their parents, whose path is computed from their own."""
    part = table(spark, sf_dir, "part")
    nodes = part.select("p_partkey", "p_brand", F.concat_ws("/", F.lit(""), "p_brand", F.col("p_partkey").cast("string"), F.lit("")).alias("path"))
    parents = part.groupBy(F.concat(F.lit("/"), "p_brand", F.lit("/")).alias("parent")).agg(F.count(F.lit(1)).alias("n_parts"))
    return nodes.join(parents, s.path_parent(F.col("path")) == F.col("parent")).select("p_partkey", "p_brand", "n_parts")


def text_matches(texts: DataFrame, key: str, text: str, weights: dict[str, int]) -> DataFrame:
    """(key, rank): the rows whose text has any of the words; rank: the sum over the words of weight times hits, at most 1000."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    worth = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    found = texts.select(F.col(key).alias("key"), F.filter(words, lambda w: w.isin(list(weights))).alias("w")).filter(F.size("w") > 0)
    return found.select("key", F.least(F.lit(1000), F.aggregate("w", F.lit(0), lambda acc, w: acc + worth[w])).alias("rank"))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
m AS (SELECT doc_id AS key, CAST(least(1000, sum(CASE word WHEN 'license' THEN 5 WHEN 'released' THEN 3 ELSE 1 END)) AS INTEGER) AS rank FROM w WHERE word IN ('license', 'released', 'public') GROUP BY 1)
SELECT doc_id, lang, source, rank FROM documents JOIN m ON doc_id = key""")
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with their rank, joined by key with the rows that they stand for."""
    docs = table(spark, sf_dir, "documents")
    found = text_matches(docs, "doc_id", "text", {"license": 5, "released": 3, "public": 1})
    return docs.select("doc_id", "lang", "source").join(found, F.col("doc_id") == F.col("key")).select("doc_id", "lang", "source", "rank")
