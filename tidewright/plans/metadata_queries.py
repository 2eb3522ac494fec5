"""Queries of what is known about tables: their DDL, references, indexes, audits, saved reports."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import audit_columns
from ..operators.catalog_audit import audit_indexes, foreign_keys, list_databases, run_audit
from ..operators.changes import OP_SQL, log_changes, operation
from ..sources.tables import TABLES, copy_table, cut, remove, shared_path, table, to_documents
from .migration import create_database, newest_reports, save_report, schema_ddl
from .registry import query


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of all tables; orders and lines in a schema of their own."""
    found = audit_columns({t: table(spark, sf_dir, t) for t in TABLES})
    return found.withColumn("schema_name", F.when(F.col("table_name").isin("orders", "lineitem"), "Sales").otherwise(F.col("schema_name")))


INFO_SQL = "SELECT CASE WHEN table_name IN ('orders', 'lineitem') THEN 'Sales' ELSE 'dbo' END AS schema_name, table_name, column_name, ordinal_position, data_type FROM information_schema.columns WHERE table_schema = 'main' AND table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ")"


@query(f"""WITH c AS ({INFO_SQL}), t AS (SELECT *, CASE data_type WHEN 'DOUBLE' THEN 'DOUBLE PRECISION' WHEN 'VARCHAR' THEN 'TEXT' WHEN 'FLOAT[]' THEN 'TEXT' ELSE data_type END || CASE WHEN ordinal_position = 1 THEN ' NOT NULL' ELSE ' NULL' END AS kind FROM c)
SELECT schema_name, table_name, 'CREATE TABLE "' || CASE schema_name WHEN 'dbo' THEN 'public' ELSE 'sales' END || '"."' || table_name || '" (' || chr(10) || '  ' || string_agg('"' || column_name || '" ' || kind, ',' || chr(10) || '  ' ORDER BY ordinal_position)
|| ',' || chr(10) || '  PRIMARY KEY ("' || max(CASE WHEN ordinal_position = 1 THEN column_name END) || '")' || chr(10) || ')' AS statement FROM t GROUP BY schema_name, table_name UNION ALL SELECT 'sales', NULL, 'CREATE SCHEMA IF NOT EXISTS "sales"'""")
def ddl_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespaces and tables as a target server is told to make them; each table's first column as its key."""
    columns = _columns(spark, sf_dir)
    keys = columns.filter("ordinal_position = 1").select("schema_name", "table_name", "column_name")
    return spark.createDataFrame(schema_ddl(columns, keys, "postgresql", "postgresql"), "schema_name string, table_name string, statement string")


@query(f"""WITH c AS ({INFO_SQL}) SELECT 'dbo' AS schema_name, c.table_name, c.column_name, 'fk_' || c.table_name || '_' || r.table_name AS constraint_name, r.table_name AS ref_table, r.column_name AS ref_column, 1 AS ordinal_position
FROM c JOIN c AS r ON r.ordinal_position = 1 AND c.table_name <> r.table_name AND substr(c.column_name, 3) = substr(r.column_name, 3)""")
def foreign_keys_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References as an information schema tells them, from names that agree behind their prefix: usage of keys joined with itself through the constraints."""
    columns = _columns(spark, sf_dir).withColumn("constraint_schema", F.lit("dbo"))
    first = columns.filter("ordinal_position = 1").select("constraint_schema", F.concat(F.lit("pk_"), "table_name").alias("constraint_name"), "table_name", "column_name", "ordinal_position")
    refer = columns.select("constraint_schema", "table_name", "column_name").alias("c").join(first.alias("r"), (F.col("c.table_name") != F.col("r.table_name")) & (F.substring("c.column_name", 3, 99) == F.substring("r.column_name", 3, 99)))
    refer = refer.select("c.*", F.concat(F.lit("fk_"), "c.table_name", F.lit("_"), "r.table_name").alias("constraint_name"), F.col("r.constraint_name").alias("unique_constraint_name"))
    usage = first.unionByName(refer.select(*[c for c in first.columns if c != "ordinal_position"], F.lit(1).alias("ordinal_position")))
    return foreign_keys(usage, refer.select("constraint_schema", "constraint_name", "unique_constraint_name").distinct())


@query(f"""WITH c AS ({INFO_SQL}) SELECT schema_name, table_name, 'ix_' || table_name AS index_name, table_name = 'orders' AS is_unique, string_agg(column_name, ', ' ORDER BY ordinal_position DESC) AS columns FROM c WHERE ordinal_position IN (2, 3) GROUP BY 1, 2""")
def indexes_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of each table over its third and second column; primary keys and the server's own are left out."""
    columns = _columns(spark, sf_dir)
    kind = lambda name, unique, seq: [F.col("schema_name").alias("table_schema"), "table_name", name.alias("index_name"), F.when(unique, 0).otherwise(1).alias("non_unique"), "column_name", seq.alias("seq_in_index")]
    own = columns.filter("ordinal_position in (2, 3)").select(*kind(F.concat(F.lit("ix_"), "table_name"), F.col("table_name") == "orders", 4 - F.col("ordinal_position")))
    keys = columns.filter("ordinal_position = 1").select(*kind(F.lit("PRIMARY"), F.lit(True), F.lit(1)))
    server = own.withColumn("table_schema", F.lit("sys"))
    return audit_indexes(own.unionByName(keys).unionByName(server))


@query("""SELECT 'catalog' AS source, 'total_tables' AS kind, 2::BIGINT AS total UNION ALL SELECT 'catalog', 'total_views', 1
UNION ALL SELECT 'catalog', 'total_columns', count(*) FROM information_schema.columns WHERE table_schema = 'main' AND table_name IN ('region', 'nation')
UNION ALL SELECT 'catalog', 'databases', 1 UNION ALL SELECT 'documents', 'total_tables', 1 UNION ALL SELECT 'documents', 'total_primary_keys', 1
UNION ALL SELECT 'documents', 'total_columns', count(*) FROM information_schema.columns WHERE table_schema = 'main' AND table_name = 'orders'""")
def audits_summarised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits in full of a database with tables and a view, and of a collection of documents: how many of each kind; the users' databases."""
    name = f"audited_{uuid.uuid4().hex}"
    try:
        create_database(spark, name)
        for t in ("region", "nation"):
            copy_table(table(spark, sf_dir, t), f"{name}.{t}")
        spark.sql(f"CREATE VIEW `{name}`.names AS SELECT n_name FROM `{name}`.nation")
        parts = {"catalog": run_audit(spark, name)["summary"].filter("kind != 'total_routines'"), "documents": run_audit(spark, "shop", {"orders": to_documents(table(spark, sf_dir, "orders"))})["summary"]}
        rows = [(source, r.kind, r.total) for source, df in parts.items() for r in df.collect()]  # a few rows
        rows.append(("catalog", "databases", sum(d == name for d in list_databases(spark))))
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")
    return spark.createDataFrame(rows, "source string, kind string, total long")


@query(" UNION ALL ".join(f"SELECT 'report_{t}' AS report, '{t}' AS object_name, count(*) AS rows_migrated FROM {t}" for t in sorted(TABLES)[-5:]))
def reports_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of each table, saved; the newest five by name, read again."""
    folder = shared_path(spark, "reports")
    for t in TABLES:
        rows = table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("rows_migrated"))
        save_report(rows.select(F.lit("data").alias("step"), F.lit(t).alias("object_name"), F.lit("success").alias("status"), "rows_migrated"), folder, f"report_{t}")
    names = newest_reports(spark, folder, 5)
    read = reduce(DataFrame.unionByName, [spark.read.schema("object_name string, rows_migrated long").json(f"{folder}/{n}").select(F.lit(n).alias("report"), "object_name", "rows_migrated") for n in names])
    out = cut(read)
    remove(spark, folder)
    return out


@query(f"SELECT {OP_SQL} AS op, upper(lpad(printf('%x', event_id), 16, '0')) || '00000000000000' || CASE WHEN event_type IN ('error', 'signup') THEN '01' ELSE '04' END AS seq, user_id, value FROM events WHERE event_id > 20")
def cdc_log_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a server's log has them, updates with both images, from behind a position on: the image after counts, and the position itself is done."""
    op, number = operation(F.col("event_type")), F.col("event_id")
    wide = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    code = F.when(op == "DELETE", F.array(F.lit(1))).when(op == "INSERT", F.array(F.lit(2))).otherwise(F.array(F.lit(3), F.lit(4)))
    seq = F.when(F.col("code") > 2, F.col("code")).otherwise(1).cast("long")
    log = table(spark, sf_dir, "events").withColumn("code", F.explode(code)).select(wide(number).alias("__$start_lsn"), wide(seq).alias("__$seqval"), F.col("code").alias("__$operation"), F.lit(b"\x0f").alias("__$update_mask"), "user_id", "value")
    return log_changes(log, (20).to_bytes(8)).select("op", "seq", "user_id", "value")


@query("""SELECT c_custkey, c.contact_id, c.name, c.role FROM customer JOIN (SELECT c_custkey AS contact_id, c_name AS name, 'customer' AS role FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier) c ON c.contact_id = c_custkey WHERE c_nationkey < 5""")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of the session that returns rows, called for each of many rows."""
    p = f"v{uuid.uuid4().hex}"
    contacts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("contact_id"), F.col("c_name").alias("name"), F.lit("customer").alias("role"))
    contacts.union(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.lit("supplier"))).createOrReplaceTempView(f"{p}_contacts")
    table(spark, sf_dir, "customer").createOrReplaceTempView(f"{p}_customer")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {p}_information(id BIGINT) RETURNS TABLE(contact_id BIGINT, name STRING, role STRING) RETURN SELECT contact_id, name, role FROM {p}_contacts WHERE contact_id = id")
    return spark.sql(f"SELECT c_custkey, t.contact_id, t.name, t.role FROM {p}_customer, LATERAL {p}_information(c_custkey) AS t WHERE c_nationkey < 5")
