"""Joins, aggregations, pivots, top-k and set operations of the translated views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import dealer_price as dealer
from ..functions.scalars import fiscal_year
from ..plans.registry import query
from ..sources.tables import TABLES, table

MONEY = "decimal(18,2)"
YEARS = list(range(1995, 2003))


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", fiscal_year(F.col("o_orderdate")).alias("fy"), F.col("o_totalprice").cast(MONEY).alias("price"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))


SALES_SQL = "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
FY_SQL = "year(o_orderdate + INTERVAL 6 MONTH)"


def _pivot_sql(missing: str) -> str:
    cells = ", ".join(f"CAST(sum(CASE WHEN {FY_SQL} = {y} THEN CAST(o_totalprice AS DECIMAL(18,2)) {missing} END) AS DECIMAL(38,4)) AS fy_{y}" for y in YEARS)
    return f"SELECT n_name, c_mktsegment, {cells} {SALES_SQL} GROUP BY 1, 2"


@query(_pivot_sql(""))
def fiscal_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales by nation and segment, a column for each fiscal year; null where there were none."""
    wide = _sales(spark, sf_dir).groupBy("n_name", "c_mktsegment").pivot("fy", YEARS).agg(F.sum("price"))
    return wide.select("n_name", "c_mktsegment", *[F.col(str(y)).cast("decimal(38,4)").alias(f"fy_{y}") for y in YEARS])


@query(_pivot_sql("ELSE 0"))
def pivot_case_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by conditional sums; zero where there were none."""
    cells = [F.sum(F.when(F.col("fy") == y, F.col("price")).otherwise(0)).cast("decimal(38,4)").alias(f"fy_{y}") for y in YEARS]
    return _sales(spark, sf_dir).groupBy("n_name", "c_mktsegment").agg(*cells)


@query("""SELECT r_name, n_name, year(o_orderdate) AS order_year, count(*) AS n_lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,4)) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""")
def star_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are summed by order before they meet the dimensions: the wide shuffle carries one row an order."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast(MONEY)).alias("r"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("order_year"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("r_name", "n_name", "order_year").agg(F.sum("n").alias("n_lines"), F.sum("r").cast("decimal(38,4)").alias("revenue"))


@query("""SELECT c_custkey, n_name, count(o_orderkey) AS n_orders, count(l_linenumber) AS n_returned
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R' GROUP BY 1, 2""")
def outer_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner, then left joins: customers without orders stay."""
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    # (one row for a line, or for an order without any): counted by order, then by customer, before they meet the customers
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("l_linenumber").alias("n"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    sums = orders.groupBy("o_custkey").agg(F.sum(F.greatest(F.lit(1), F.coalesce("n", F.lit(0)))).alias("orders"), F.sum("n").alias("returned"))
    joined = customers.join(sums, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "n_name", F.coalesce("orders", F.lit(0)).alias("n_orders"), F.coalesce("returned", F.lit(0)).alias("n_returned"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '2000-01-01')")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' and o_orderdate >= timestamp_ntz'2000-01-01'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '1999-01-01')")
def anti_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one set that the other lacks."""
    known = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' and o_orderdate >= timestamp_ntz'1999-01-01'")
    return table(spark, sf_dir, "customer").join(known, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


def valid_at(facts: DataFrame, periods: DataFrame, key: list[str], at: str, start: str, end: str) -> DataFrame:
    """Facts with the period of the same key that holds at their time; an open end never ends."""
    inside = (F.col(at) >= F.col(start)) & (F.col(at) <= F.coalesce(F.col(end), F.lit("9999-12-31").cast("timestamp_ntz")))
    return facts.join(periods, key, "inner").filter(inside)


def as_of(facts: DataFrame, periods: DataFrame, key: list[str], at: str, start: str, end: str, bucket_days: int = 365) -> DataFrame:
    """valid_at() for periods of a key that do not overlap: each fact meets the last period that starts no later, if it has not ended.

    Facts and periods are sorted together, so a key costs its rows, not their product. A
    key is cut into buckets of time; the last period that starts in each bucket goes into the
    later ones as a row that starts them, so that one shuffle by key and bucket carries all.
    """
    own = [c for c in periods.columns if c not in key]
    period = F.struct(F.col(start).alias("__at"), *[F.col(c).alias(f"__{c}") for c in own])
    days = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / (86400 * bucket_days))
    # an empty period holds at no time
    begun = periods.filter(F.col(end).isNull() | (F.col(end) >= F.col(start))).select(*key, days(start).alias("__b"), F.col(start).alias("__t"), F.lit(1).alias("__kind"), period.alias("__p"))
    asked = facts.select(*key, days(at).alias("__b"), F.col(at).alias("__t"), F.lit(2).alias("__kind"), F.struct(*[F.col(c) for c in facts.columns]).alias("__f"))
    # what stands at a bucket's start, by narrow rows: one for each bucket of a key that has any
    last = begun.groupBy(*key, "__b").agg(F.max("__p").alias("__p"))
    wanted = asked.select(*key, "__b").distinct().select(*key, "__b", F.lit(None).cast(last.schema["__p"].dataType).alias("__p"))
    marks = last.unionByName(wanted).groupBy(*key, "__b").agg(F.max("__p").alias("__p"), F.count_if(F.col("__p").isNull()).alias("__n"))
    before = marks.withColumn("__p", F.last("__p", ignorenulls=True).over(Window.partitionBy(*key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).filter("__n > 0 and __p is not null")
    started = before.select(*key, "__b", F.lit(None).cast(facts.schema[at].dataType).alias("__t"), F.lit(0).alias("__kind"), "__p")
    both = started.unionByName(begun).unionByName(asked, allowMissingColumns=True)
    found = both.withColumn("__held", F.last("__p", ignorenulls=True).over(Window.partitionBy(*key, "__b").orderBy(F.col("__t").asc_nulls_first(), "__kind"))).filter("__kind = 2")
    holds = F.col("__held").isNotNull() & (F.col(f"__held.__{end}").isNull() | (F.col("__t") <= F.col(f"__held.__{end}")))
    return found.filter(holds).select("__f.*", *[F.col(f"__held.__{c}").alias(c) for c in own])


@query("""WITH h AS (SELECT o_custkey AS k, o_orderkey AS price_order, o_totalprice AS price, o_orderdate AS start_date, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - INTERVAL 1 SECOND AS end_date FROM orders)
SELECT o_orderkey, price_order, price FROM orders JOIN h ON o_custkey = k AND o_orderdate + INTERVAL 10 DAY BETWEEN start_date AND coalesce(end_date, TIMESTAMP '9999-12-31')""")
def temporal_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer's latest order price as it stood ten days after each order."""
    orders = table(spark, sf_dir, "orders")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    history = orders.select(F.col("o_custkey"), F.col("o_orderkey").alias("price_order"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("start_date"), (F.lead("o_orderdate").over(order) - F.expr("INTERVAL 1 SECOND")).alias("end_date"))
    asked = orders.select("o_custkey", "o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 10 DAY")).alias("at"))
    return as_of(asked, history, ["o_custkey"], "at", "start_date", "end_date").select("o_orderkey", "price_order", "price")


@query("SELECT r_regionkey, r_name, (SELECT count(*) FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS n_customers FROM region")
def correlated_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar subquery for each row, as an aggregate and a left join."""
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    by_region = table(spark, sf_dir, "nation").join(counts, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.sum("n").alias("n"))
    return table(spark, sf_dir, "region").join(by_region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("r_regionkey", "r_name", F.coalesce("n", F.lit(0)).alias("n_customers"))


@query("SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS nations, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def ordered_listagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("nations"), F.count(F.lit(1)).alias("n"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES))
def global_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t in TABLES:
        one = table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT p_partkey, coalesce((SELECT sum(l_quantity) FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'A' AND l_linenumber = 6), 0) AS stock FROM part")
def stock_or_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stock of each part at one place; zero where there is none."""
    here = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A' and l_linenumber = 6").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    return table(spark, sf_dir, "part").select("p_partkey").join(here, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", F.coalesce("q", F.lit(0.0)).alias("stock"))


@query("""SELECT l_orderkey, l_linenumber, CAST(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(0.60 AS DECIMAL(3,2)) AS DECIMAL(20,4)) AS dealer_price
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1998-01-01'""")
def dealer_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_shipdate >= timestamp_ntz'1998-01-01'").select("l_orderkey", "l_linenumber", "l_partkey")
    return lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", dealer(F.col("p_retailprice")).alias("dealer_price"))


@query("""SELECT c_custkey AS contact_id, c_name AS name, 'customer' AS role FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey)
UNION ALL SELECT c_custkey, c_name, 'prospect' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def contact_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts of every role."""
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    orders = table(spark, sf_dir, "orders").select("o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey")
    ordered = F.col("o_custkey") == F.col("c_custkey")
    branch = lambda df, key, name, role: df.select(F.col(key).alias("contact_id"), F.col(name).alias("name"), F.lit(role).alias("role"))
    return (
        branch(customer.join(orders, ordered, "left_semi"), "c_custkey", "c_name", "customer")
        .unionByName(branch(supplier.join(lines, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi"), "s_suppkey", "s_name", "supplier"))
        .unionByName(branch(customer.join(orders, ordered, "left_anti"), "c_custkey", "c_name", "prospect"))
    )


@query("""SELECT conv_id, turn, word, n FROM (SELECT conv_id, turn, word, count(*) AS n FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM conversations) GROUP BY 1, 2, 3) WHERE n > 2""")
def lateral_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows multiplied by the elements of a value of theirs."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split("text", " ")).alias("word"))
    return words.groupBy("conv_id", "turn", "word").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")


def changes_after(df: DataFrame, at: str, key: str, checkpoint: Column, most: int, last_key: Column | None = None) -> DataFrame:
    """The oldest changes after the checkpoint; those of one time come in the order of the key. With the key of the last row seen at the checkpoint's time, rows of that time that are still unseen come too."""
    later = F.col(at) > checkpoint
    if last_key is not None:
        # the plain bound is what a scan can skip files by
        later = (F.col(at) >= checkpoint) & (later | (F.col(key) > last_key))
    return df.filter(later).orderBy(at, key).limit(most)


@query("SELECT event_id, ts, user_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-10' ORDER BY ts, event_id LIMIT 1000")
def poll_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes_after(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"), "ts", "event_id", F.lit("2024-01-10").cast("timestamp_ntz"), 1000)


@query("SELECT event_type, event_id, ts FROM (SELECT event_type, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events WHERE ts > TIMESTAMP '2024-01-05') WHERE n <= 100")
def poll_topk_per_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest 100 changes of each source; Spark keeps 100 of a source in each task before the shuffle."""
    order = Window.partitionBy("event_type").orderBy("ts", "event_id")
    new = table(spark, sf_dir, "events").filter("ts > timestamp_ntz'2024-01-05'").select("event_type", "event_id", "ts")
    return new.withColumn("n", F.row_number().over(order)).filter("n <= 100").drop("n")


@query("SELECT event_id, day, event_type FROM (SELECT event_id, date_trunc('day', ts) AS day, event_type FROM events WHERE ts > TIMESTAMP '2024-01-10') ORDER BY day, event_id LIMIT 500 OFFSET 500")
def poll_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second poll goes on from the last row of the first, though many rows share its time."""
    events = table(spark, sf_dir, "events").filter("ts > timestamp_ntz'2024-01-10'").select("event_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type")
    seen = changes_after(events, "day", "event_id", F.lit("2000-01-01").cast("timestamp_ntz"), 500).agg(F.max(F.struct("day", "event_id")).alias("m")).first().m
    if seen is None:
        return events.limit(0)
    return changes_after(events, "day", "event_id", F.lit(seen.day).cast("timestamp_ntz"), 500, F.lit(seen.event_id))


@query("SELECT conv_id, turn, word FROM conversations LEFT JOIN LATERAL (SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(text, ' ')) AS w) WHERE length(w) > 11) ON true")
def outer_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows multiplied by the elements of a value of theirs; a row without elements stays."""
    long_words = F.array_distinct(F.filter(F.split("text", " "), lambda w: F.length(w) > 11))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode_outer(long_words).alias("word"))


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_partkey, l_suppkey, l_returnflag) AS n_same FROM lineitem")
def composite_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the lines of the same part, supplier and flag: the other side is counted by key before it is joined."""
    lines, keys = table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey", "l_returnflag"]
    counts = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_same"))
    return lines.select("l_orderkey", "l_linenumber", *keys).join(counts, keys).select("l_orderkey", "l_linenumber", "n_same")


@query("SELECT l_partkey, sum(l_quantity) AS stock, count(*) AS n FROM lineitem WHERE l_linenumber = 6 GROUP BY 1")
def text_number_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number compared with a text that names one: the text is read as a number, once, so that the scan can skip files."""
    here = table(spark, sf_dir, "lineitem").filter(F.col("l_linenumber") == F.lit("6").cast("int"))
    return here.groupBy("l_partkey").agg(F.sum("l_quantity").alias("stock"), F.count(F.lit(1)).alias("n"))
