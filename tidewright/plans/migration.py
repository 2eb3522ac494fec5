"""Moving a database: create, copy, views, new tables, changes; every step's outcome is a row of the report."""

from __future__ import annotations

import functools
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.naming import DEFAULT_SCHEMAS, flat_name, held_names, parse_table, quote, sanitized, table_name
from ..functions.types import create_table as create_table_text
from ..functions.types import spark_type
from ..operators.catalog_audit import audit_tables
from ..operators.changes import apply_changes
from ..operators.documents import document_rows, infer_fields, read_collection, write_collection
from ..sources.tables import TABLES, copy_table, cut, remove, shared_path, table
from .registry import query

REPORT = "step string, object_name string, status string, rows_migrated long, error string"
MODES = ("schema", "data", "full")


def create_database(spark: SparkSession, name: str, replace: bool = False) -> None:
    """Creates the database if there is none; with replace, whatever it held goes."""
    if replace:
        spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def create_table(spark: SparkSession, target: str, schema: T.StructType) -> str:
    """An empty table, names in lower case; the status."""
    if spark.catalog.tableExists(target):
        return "exists"
    spark.catalog.createTable(target, source="parquet", schema=T.StructType([T.StructField(f.name.lower(), f.dataType, f.nullable) for f in schema]))
    return "success"


def deploy_views(spark: SparkSession, views: dict[str, str]) -> list[tuple]:
    """Temporary views in the order given, later ones may read earlier ones; report rows. A view that can't be resolved is reported with its error, never stubbed."""
    rows = []
    for name, text in views.items():
        try:
            spark.sql(text).createOrReplaceTempView(name)
            rows.append(("view", name, "success", None, None))
        except Exception as e:  # one view's failure is a row of the report
            rows.append(("view", name, "failed", None, str(e)[:500]))
    return rows


def flat(name: str, schema: str = "dbo") -> str:
    """The name of a table in a flat namespace: that of its schema goes before it, unless it is the default one."""
    return flat_name(*parse_table(name, schema))


def together(spark: SparkSession, jobs: dict[str, Callable[[], object]], workers: int = 4, seconds: float | None = None) -> dict[str, object]:
    """What each of the jobs returns or raises, `workers` of them at a time on threads of the driver.

    Each has a job group and a scheduler pool of its own name: under fair scheduling they
    share the cluster evenly, and one that takes longer than `seconds` is cancelled alone.
    """
    context, run = spark.sparkContext, uuid.uuid4().hex[:8]

    def one(name: str, job: Callable[[], object]) -> object:
        group, late = f"{run}-{name}", threading.Event()
        context.setLocalProperty("spark.scheduler.pool", group)
        context.setJobGroup(group, name, True)
        watch = threading.Timer(seconds, lambda: (late.set(), context.cancelJobGroup(group))) if seconds else None
        if watch:
            watch.start()
        try:
            return job()
        except Exception as e:
            return TimeoutError(f"cancelled after {seconds} s") if late.is_set() else e
        finally:
            if watch:
                watch.cancel()
            context.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(workers) as pool:
        running = {name: pool.submit(inheritable_thread_target(spark)(one), name, job) for name, job in jobs.items()}
        return {name: f.result() for name, f in running.items()}


def migrate(spark: SparkSession, source: dict[str, DataFrame], target: str, mode: str = "full", replace: bool = False, views: dict[str, str] | None = None, workers: int = 1, seconds: float | None = None) -> DataFrame:
    """The report of a move of all tables of source into the database target.

    Names may have a schema before a dot; those that fall together, as Orders and orders,
    are told apart by numbers.

    schema: empty tables; data: tables with their rows; full: views too. A table that
    fails is a row of the report, and the others go on. workers: tables that are copied at
    a time; seconds: after which a copy is given up.
    """
    if mode not in MODES:
        raise ValueError(f"mode: one of {', '.join(MODES)}")
    create_database(spark, target, replace)
    rows, held = [], held_names(list(source), flat)
    full = {name: f"{target}.`{held[name]}`" for name in sorted(source)}
    if mode == "schema":
        rows += [("schema", name, create_table(spark, at, source[name].schema), None, None) for name, at in full.items()]
    else:
        jobs = {name: functools.partial(copy_table, source[name], at) for name, at in full.items()}
        for name, got in together(spark, jobs, workers, seconds).items():
            failed = isinstance(got, Exception)
            rows.append(("data", name, "failed", 0, str(got)[:500]) if failed else ("data", name, got["status"], got["rows_migrated"], got["error"]))
    if mode == "full":
        rows += deploy_views(spark, views or {})
    return spark.createDataFrame(rows, REPORT)


def sync(spark: SparkSession, source: dict[str, DataFrame], target: str, changes: dict[str, tuple[DataFrame, list[str], list[str]]] | None = None) -> DataFrame:
    """The report of bringing target up to date: tables that it lacks are copied, the others take their changes.

    changes: by table, the change rows (with op), their key columns and the columns
    that order them. Nothing is dropped; a repeated sync changes nothing.
    """
    create_database(spark, target)
    rows = []
    for name, df in sorted(source.items()):
        if not spark.catalog.tableExists(f"{target}.{name.lower()}"):
            got = copy_table(df, f"{target}.{name.lower()}")
            rows.append(("new table", name, got["status"], got["rows_migrated"], got["error"]))
    for name, (made, key, seq) in sorted((changes or {}).items()):
        full = f"{target}.{name.lower()}"
        # written to the shared folder first: a table can't be overwritten while it is read
        after = cut(apply_changes(spark.table(full), made, key, seq))
        got = copy_table(after, full)
        rows.append(("changes", name, got["status"], got["rows_migrated"], got["error"]))
    return spark.createDataFrame(rows, REPORT)


def migrate_documents(spark: SparkSession, collections: dict[str, DataFrame], target: str, column: str = "document") -> DataFrame:
    """(collection_name, table_name, status, rows, error): collections of JSON documents as tables of the database target.

    Of each, the fields of all documents are inferred, nested ones side by side, and the
    table is swapped in when it is whole. An empty collection is skipped; one that fails
    is a row of the report, and the others go on.
    """
    create_database(spark, target)
    rows, names = [], held_names(list(collections), sanitized)
    for name, documents in sorted(collections.items()):
        held = names[name]
        try:
            fields = [(r.path, r.inferred) for r in infer_fields(documents, column).collect()]  # one row a field
        except Exception as e:  # one collection's failure is a row of the report
            rows.append((name, held, "failed", 0, str(e)[:500]))
            continue
        if not fields:
            rows.append((name, None, "skipped", 0, "Empty collection"))
            continue
        got = copy_table(document_rows(documents, column, fields), f"{target}.{held}")
        rows.append((name, held, got["status"], got["rows_migrated"], got["error"]))
    return spark.createDataFrame(rows, "collection_name string, table_name string, status string, rows long, error string")


def export_documents(spark: SparkSession, tables: dict[str, DataFrame], folder: str, schema: str = "dbo") -> DataFrame:
    """(table_name, collection_name, status, documents, error): tables as collections, one folder of JSON lines each."""
    rows, names = [], held_names(list(tables), lambda n: flat(n, schema))
    for name, df in sorted(tables.items()):
        held = names[name]
        try:
            rows.append((".".join(parse_table(name, schema)), held, "success", write_collection(df, f"{folder}/{held}"), None))
        except Exception as e:  # one table's failure is a row of the report
            rows.append((".".join(parse_table(name, schema)), "", "failed", 0, str(e)[:500]))
    return spark.createDataFrame(rows, "table_name string, collection_name string, status string, documents long, error string")


def schema_ddl(columns: DataFrame, keys: DataFrame, source: str, target: str) -> list[tuple[str | None, str | None, str]]:
    """(schema_name, table_name, statement): namespaces first, sorted, then the tables that an audit found; tables without columns have none.

    columns: as audit_columns() gives them, data types by the names of the source; keys:
    (schema_name, table_name, column_name). What reaches the driver is one row a column.
    """
    made: list[tuple[str | None, str | None, str]] = []
    if target != "mysql":
        spaces = columns.select(F.lower("schema_name").alias("s")).distinct().orderBy("s").collect()
        made += [(r.s, None, f"CREATE SCHEMA IF NOT EXISTS {quote(r.s, target)}") for r in spaces if r.s and r.s not in DEFAULT_SCHEMAS]
    of = ["schema_name", "table_name"]
    listed = columns.groupBy(*of).agg(F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name", "data_type", "character_maximum_length", "numeric_precision", "numeric_scale", "is_nullable"))).alias("columns"))
    keyed = keys.groupBy(*of).agg(F.collect_list("column_name").alias("keys"))
    for r in listed.join(keyed, of, "left").orderBy(*of).collect():
        fields = [T.StructField(c.column_name, spark_type(source, c.data_type, c.character_maximum_length, c.numeric_precision, c.numeric_scale), c.is_nullable != "NO") for c in r["columns"]]
        made.append((r.schema_name, r.table_name, create_table_text(table_name(r.schema_name, r.table_name, target), T.StructType(fields), target, tuple(r["keys"] or ()))))
    return made


def totals(report: DataFrame) -> DataFrame:
    """(step, status, n, rows_migrated) of a report."""
    return report.groupBy("step", "status").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("rows_migrated"), F.lit(0)).alias("rows_migrated"))


def save_report(report: DataFrame, folder: str, name: str) -> None:
    """As JSON lines in a folder of its own."""
    report.write.mode("overwrite").json(f"{folder}/{name}")


def newest_reports(spark: SparkSession, folder: str, most: int = 15) -> list[str]:
    """Names of the saved reports, the largest (names carry the time) first."""
    names = spark.read.text(f"{folder}/*").select(F.regexp_extract("_metadata.file_path", "/([^/]+)/[^/]+$", 1).alias("name")).distinct()
    return [r.name for r in names.orderBy(F.desc("name")).limit(most).collect()]


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, 'success' AS status, count(*) AS rows_migrated, count(*) AS rows_found FROM {t}" for t in TABLES))
def migrate_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables moved into a database of their own: what the report says of each, and the rows that an audit then finds there."""
    target = f"moved_{uuid.uuid4().hex}"
    try:
        report = migrate(spark, {t: table(spark, sf_dir, t) for t in TABLES}, target)
        found = report.join(audit_tables(spark, target), F.col("object_name") == F.col("table_name"))
        rows = [tuple(r) for r in found.select("table_name", "status", "rows_migrated", F.col("row_count").alias("rows_found")).collect()]  # one row a table
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS `{target}` CASCADE")
    return spark.createDataFrame(rows, "table_name string, status string, rows_migrated long, rows_found long")


@query("""SELECT n_name, count(*) AS n_customers, CAST(sum(CAST(price AS DECIMAL(38,4))) AS DECIMAL(38,4)) AS sales FROM (SELECT n_name, c_custkey, coalesce((SELECT sum(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders WHERE o_custkey = c_custkey), 0) AS price
FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1""")
def view_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views over tables, and a view over views, deployed by name and read."""
    p = f"v{uuid.uuid4().hex}_"
    for t in ("customer", "nation", "orders"):
        table(spark, sf_dir, t).createOrReplaceTempView(p + t)
    views = {
        f"{p}spent": f"SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS price FROM {p}orders GROUP BY o_custkey",
        f"{p}buyers": f"SELECT c_custkey, n_name, coalesce(price, 0) AS price FROM {p}customer JOIN {p}nation ON c_nationkey = n_nationkey LEFT JOIN {p}spent ON o_custkey = c_custkey",
        f"{p}by_nation": f"SELECT n_name, count(*) AS n_customers, CAST(sum(price) AS DECIMAL(38,4)) AS sales FROM {p}buyers GROUP BY n_name",
    }
    if failed := [r for r in deploy_views(spark, views) if r[2] != "success"]:
        raise RuntimeError(str(failed))
    out = spark.table(f"{p}by_nation")
    for v in [p + t for t in ("customer", "nation", "orders")] + list(views):
        spark.catalog.dropTempView(v)
    return out


@query("""SELECT event_id AS id, event_type AS meta_kind, CASE WHEN event_id % 2 = 0 THEN user_id ELSE NULL END AS meta_who_user, value, '0' || user_id AS zip, '[' || event_id || ',"x"]' AS tags FROM events""")
def documents_to_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as a collection of nested documents, moved into a table, and read there."""
    who = F.when(F.col("event_id") % 2 == 0, F.struct(F.col("user_id").alias("user")))
    made = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.struct(F.col("event_type").alias("kind"), who.alias("who")).alias("meta"), "value", F.concat(F.lit("0"), F.col("user_id").cast("string")).alias("zip"),
        F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit(',"x"]')).alias("tags"),
    )
    # lists are given as text here, and put into the document as they are
    text = F.concat(F.expr("substring(to_json(struct(id, meta, value, zip)), 1, length(to_json(struct(id, meta, value, zip))) - 1)"), F.lit(', "tags": '), "tags", F.lit("}"))
    folder, target = shared_path(spark, "collection"), f"moved_{uuid.uuid4().hex}"
    made.select(text.alias("value")).write.text(folder)
    try:
        report = migrate_documents(spark, {"events": read_collection(spark, folder)}, target)
        if failed := report.filter("status != 'success'").collect():
            raise RuntimeError(str(failed))
        return cut(spark.table(f"{target}.events"))
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS `{target}` CASCADE")
        remove(spark, folder)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders")
def tables_to_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a collection, and the collection as rows again."""
    folder = shared_path(spark, "export")
    orders = table(spark, sf_dir, "orders")
    try:
        if failed := export_documents(spark, {"orders": orders}, folder).filter("status != 'success'").collect():
            raise RuntimeError(str(failed))
        read = read_collection(spark, f"{folder}/orders").select(F.from_json("document", orders.schema).alias("d")).select("d.*")
        return cut(read.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")))
    finally:
        remove(spark, folder)
