"""Audits of the session's catalog: databases, tables with their rows, views, functions; references between keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit import COLUMNS, audit_columns
from .documents import infer_fields

#: Databases that belong to a server, not to its users: fixed values.
SYSTEM_DATABASES = ("information_schema", "sys", "master", "model", "msdb", "tempdb", "mysql", "performance_schema", "postgres", "template0", "template1", "admin", "local", "config")


def list_databases(spark: SparkSession) -> list[str]:
    """The users' databases, sorted."""
    return sorted(d.name for d in spark.catalog.listDatabases() if d.name.lower() not in SYSTEM_DATABASES)


def audit_tables(spark: SparkSession, database: str) -> DataFrame:
    """(schema_name, table_name, row_count): real counts, all tables in one job. An empty database gives no rows."""
    out = spark.createDataFrame([], "schema_name string, table_name string, row_count long")
    for t in sorted(x.name for x in spark.catalog.listTables(database) if x.tableType != "VIEW" and not x.isTemporary):
        one = spark.table(f"`{database}`.`{t}`").agg(F.count(F.lit(1)).alias("row_count"))
        out = out.unionByName(one.select(F.lit(database).alias("schema_name"), F.lit(t).alias("table_name"), "row_count"))
    return out


def register_server(spark: SparkSession, name: str, options: dict[str, str]) -> None:
    """Makes a server a catalog of the session: its tables can then be listed, read and counted as name.schema.table; counts are left to the server."""
    spark.conf.set(f"spark.sql.catalog.{name}", "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
    for k, v in ({"pushDownAggregate": "true"} | options).items():
        spark.conf.set(f"spark.sql.catalog.{name}.{k}", v)


def audit_server(spark: SparkSession, catalog: str, schema: str) -> dict[str, DataFrame]:
    """tables and columns of a schema of a registered server, as run_audit() gives them for a database; names in lower case."""
    names = sorted(r.tableName for r in spark.sql(f"SHOW TABLES IN `{catalog}`.`{schema}`").collect())
    held = {n: spark.table(f"`{catalog}`.`{schema}`.`{n}`") for n in names}
    tables = spark.createDataFrame([], "schema_name string, table_name string, row_count long")
    for n, df in held.items():
        tables = tables.unionByName(df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(schema.lower()).alias("schema_name"), F.lit(n.lower()).alias("table_name"), "row_count"))
    columns = audit_columns({n.lower(): df for n, df in held.items()}, schema.lower()).withColumn("column_name", F.lower("column_name")) if held else spark.createDataFrame([], COLUMNS)
    return {"tables": tables, "columns": columns}


def audit_views(spark: SparkSession, database: str) -> DataFrame:
    """(schema_name, view_name, definition)."""
    names = sorted(x.name for x in spark.catalog.listTables(database) if x.tableType == "VIEW" and not x.isTemporary)
    rows = [(database, v, spark.sql(f"SHOW CREATE TABLE `{database}`.`{v}`").first()[0]) for v in names]
    return spark.createDataFrame(rows, "schema_name string, view_name string, definition string")


def audit_functions(spark: SparkSession, database: str) -> DataFrame:
    """(routine_name, definition): the users' functions that the database and the session have."""
    names = sorted(r[0] for r in spark.sql(f"SHOW USER FUNCTIONS IN `{database}`").collect())
    rows = [(n, "\n".join(r[0] for r in spark.sql(f"DESCRIBE FUNCTION EXTENDED {n}").collect())) for n in names]
    return spark.createDataFrame(rows, "routine_name string, definition string")


def foreign_keys(usage: DataFrame, constraints: DataFrame) -> DataFrame:
    """Columns that refer and columns referred to, paired by their place in the key, so that a composite key makes one row a column.

    usage: (constraint_schema, constraint_name, table_name, column_name, ordinal_position);
    constraints: (constraint_schema, constraint_name, unique_constraint_name).
    """
    by = ["constraint_schema", "constraint_name"]
    own = usage.join(constraints, by)
    other = usage.select("constraint_schema", F.col("constraint_name").alias("unique_constraint_name"), F.col("table_name").alias("ref_table"), F.col("column_name").alias("ref_column"), "ordinal_position")
    joined = own.join(other, ["constraint_schema", "unique_constraint_name", "ordinal_position"])
    return joined.select(F.col("constraint_schema").alias("schema_name"), "table_name", "column_name", "constraint_name", "ref_table", "ref_column", "ordinal_position")


def audit_indexes(statistics: DataFrame) -> DataFrame:
    """(schema_name, table_name, index_name, is_unique, columns): the indexes besides primary keys, their columns in order.

    statistics: (table_schema, table_name, index_name, non_unique, column_name, seq_in_index), as an information schema has them.
    """
    own = statistics.filter(~F.col("table_schema").isin(*SYSTEM_DATABASES) & (F.col("index_name") != "PRIMARY") & ~F.col("index_name").like("%\\_pkey"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq_in_index", "column_name"))), lambda x: x["column_name"]), ", ")
    found = own.groupBy(F.col("table_schema").alias("schema_name"), "table_name", "index_name").agg((F.max("non_unique") == 0).alias("is_unique"), listed.alias("columns"))
    return found.orderBy("schema_name", "table_name", "index_name")


def audit_collections(spark: SparkSession, database: str, collections: dict[str, DataFrame], column: str = "document") -> dict[str, DataFrame]:
    """The audit of a document database: collections with their counts, their fields with the types inferred from all documents, and the key that each has."""
    tables = spark.createDataFrame([], "schema_name string, table_name string, row_count long")
    columns = spark.createDataFrame([], COLUMNS)
    for name, documents in sorted(collections.items()):
        tables = tables.unionByName(documents.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(database).alias("schema_name"), F.lit(name).alias("table_name"), "row_count"))
        fields = infer_fields(documents, column).select(F.lit(database).alias("schema_name"), F.lit(name).alias("table_name"), F.col("field").alias("column_name"), F.lit(0).alias("ordinal_position"), F.col("inferred").alias("data_type"), F.lit("YES").alias("is_nullable"))
        columns = columns.unionByName(fields, allowMissingColumns=True)
    keys = tables.select("schema_name", "table_name", F.lit("_id").alias("column_name"), F.lit("_id_").alias("constraint_name"))
    return {"tables": tables, "columns": columns, "primary_keys": keys}


def run_audit(spark: SparkSession, database: str, collections: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The parts of an audit by name, and `summary`: (kind, total) of each part.

    A database of the catalog has tables, columns, views and routines; with collections,
    a document database has collections, fields and keys.
    """
    if collections is None:
        names = sorted(x.name for x in spark.catalog.listTables(database) if x.tableType != "VIEW" and not x.isTemporary)
        held = {t: spark.table(f"`{database}`.`{t}`") for t in names}
        columns = audit_columns(held, database) if held else spark.createDataFrame([], COLUMNS)
        parts = {"tables": audit_tables(spark, database), "columns": columns, "views": audit_views(spark, database), "routines": audit_functions(spark, database)}
    else:
        parts = audit_collections(spark, database, collections)
    counted = [df.agg(F.count(F.lit(1)).alias("total")).select(F.lit(f"total_{kind}").alias("kind"), "total") for kind, df in parts.items()]
    return parts | {"summary": reduce(DataFrame.unionByName, counted)}
