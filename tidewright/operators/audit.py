"""Audits: columns, key candidates and references of tables, as DataFrames."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.registry import query
from ..sources.tables import TABLES, table

COLUMNS = (
    "schema_name string, table_name string, column_name string, ordinal_position int, data_type string, character_maximum_length long, "
    "numeric_precision int, numeric_scale int, is_nullable string, column_default string"
)
#: Bits of the number types, and their names in SQL: fixed values.
BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64, "float": 24, "double": 53}
NAMES = {"tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "float": "FLOAT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "binary": "BLOB", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE"}


def sql_name(kind: T.DataType) -> str:
    """The name of a Spark type in an information schema."""
    if isinstance(kind, T.ArrayType):
        return f"{sql_name(kind.elementType)}[]"
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    if isinstance(kind, (T.CharType, T.VarcharType)):
        return "VARCHAR"
    return NAMES.get(kind.simpleString(), kind.simpleString().upper())


def audit_columns(tables: dict[str, DataFrame], schema: str = "dbo") -> DataFrame:
    """One row for each column of each table, from the tables' own schemas: type, length, precision, scale, default."""
    rows = []
    for t, df in sorted(tables.items()):
        for n, f in enumerate(df.schema, 1):
            # a table keeps the declared length and default of a column beside its type
            declared = re.fullmatch(r"(?:var)?char\((\d+)\)", f.metadata.get("__CHAR_VARCHAR_TYPE_STRING", f.dataType.simpleString()))
            bits = BITS.get(f.dataType.simpleString())
            sizes = (f.dataType.precision, f.dataType.scale) if isinstance(f.dataType, T.DecimalType) else (bits, None if bits is None else 0)
            rows.append((schema, t, f.name, n, sql_name(f.dataType), int(declared[1]) if declared else None, *sizes, "YES" if f.nullable else "NO", f.metadata.get("CURRENT_DEFAULT")))
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, COLUMNS)


def digest(column: Column, kind: T.DataType) -> Column:
    """Two 64-bit hashes that tell values apart, null for null. Lists, maps and structs count by their JSON text: their own hash skips nulls inside."""
    whole = F.to_json(F.struct(column.alias("v")), {"ignoreNullFields": "false"}) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) else column
    return F.when(column.isNotNull(), F.struct(F.xxhash64(F.lit(1), whole).alias("a"), F.xxhash64(F.lit(2), whole).alias("b")))


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """(table_name, column_name, n_rows, n_values, n_distinct, longest) of every column, the table read once. Values are told apart by digests; longest: characters of the longest text, null for other types."""
    text = [isinstance(f.dataType, T.StringType) for f in df.schema]
    cells = F.array(*[F.struct(F.lit(n).alias("c"), digest(F.col(f"`{f.name}`"), f.dataType).alias("h"), (F.length(F.col(f"`{f.name}`")) if t else F.lit(None).cast("int")).alias("l")) for n, (f, t) in enumerate(zip(df.schema, text, strict=True))])
    # a value's rows are counted before the values are: a hot value is one row of each task
    groups = df.select(F.explode(cells).alias("x")).groupBy("x.c", "x.h.a", "x.h.b").agg(F.count(F.lit(1)).alias("n"), F.max("x.l").alias("l"))
    counted = groups.groupBy("c").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("a").isNotNull(), F.col("n"))), F.lit(0)).alias("n_values"), F.count("a").alias("n_distinct"), F.max("l").cast("long").alias("longest"))
    return counted.select(F.lit(name).alias("table_name"), F.element_at(F.array(*[F.lit(c) for c in df.columns]), F.col("c") + 1).alias("column_name"), "n_rows", "n_values", "n_distinct", "longest")


def key_candidate(df: DataFrame, keys: list[str]) -> DataFrame:
    """(n_rows, n_keys, n_null, is_key): the keys are counted by groups, so no task sees more than its share."""
    none = F.lit(False)
    for k in keys:
        none = none | F.col(k).isNull()
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum(F.when(none, F.col("n"))), F.lit(0)).alias("n_null"))
    return out.withColumn("is_key", (F.col("n_rows") == F.col("n_keys")) & (F.col("n_null") == 0))


def orphans(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows of child whose reference the parent lacks."""
    on = None
    for c, p in keys.items():
        one = F.col(c) == F.col(p)
        on = one if on is None else on & one
    return child.join(parent.select(*keys.values()), on, "left_anti")


@query("""SELECT 'orders' AS table_name, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, count(*) = count(DISTINCT o_orderkey) AS is_key FROM orders
UNION ALL SELECT 'lineitem', count(*), count(DISTINCT (l_orderkey, l_linenumber)), count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem
UNION ALL SELECT 'events', count(*), count(DISTINCT user_id), count(*) = count(DISTINCT user_id) FROM events""")
def pk_candidate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, keys in (("orders", ["o_orderkey"]), ("lineitem", ["l_orderkey", "l_linenumber"]), ("events", ["user_id"])):
        one = key_candidate(table(spark, sf_dir, t), keys).select(F.lit(t).alias("table_name"), "n_rows", "n_keys", "is_key")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT 'lineitem.l_orderkey' AS reference, count(*) AS n_orphans FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')
UNION ALL SELECT 'labels.doc_id', count(*) FROM labels WHERE NOT EXISTS (SELECT 1 FROM documents WHERE documents.doc_id = labels.doc_id AND lang = 'en')""")
def fk_orphan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = orphans(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"), {"l_orderkey": "o_orderkey"})
    labels = orphans(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").filter("lang = 'en'").withColumnRenamed("doc_id", "d"), {"doc_id": "d"})
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n_orphans")).select(F.lit(name).alias("reference"), "n_orphans")
    return count(lines, "lineitem.l_orderkey").unionByName(count(labels, "labels.doc_id"))


AUDITED = {
    "region": "r_regionkey r_name*", "nation": "n_nationkey n_name* n_regionkey", "supplier": "s_suppkey s_name* s_nationkey s_acctbal", "customer": "c_custkey c_name* c_nationkey c_acctbal c_mktsegment*",
    "part": "p_partkey p_name* p_brand* p_type* p_size p_retailprice", "orders": "o_orderkey o_custkey o_orderstatus* o_totalprice o_orderdate o_orderpriority*",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag* l_linestatus* l_shipdate", "events": "event_id ts user_id event_type* value props*",
    "documents": "doc_id text* lang* source* n_chars", "embeddings": "vec_id embedding label", "pages": "page_id url* html*", "benchmark": "item_id text*", "labels": "doc_id quality toxic", "conversations": "conv_id turn role* text*",
}


def _columns_audit_sql() -> str:
    one = "SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_values, count(DISTINCT {c}) AS n_distinct, CAST({l} AS BIGINT) AS longest FROM {t}"
    return " UNION ALL ".join(one.format(t=t, c=c.strip("*"), l=f"max(length({c[:-1]}))" if c.endswith("*") else "NULL") for t, columns in AUDITED.items() for c in columns.split())


@query(_columns_audit_sql())
def columns_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the columns of all tables hold: rows, values, distinct values, longest text."""
    return reduce(DataFrame.unionByName, [value_counts(table(spark, sf_dir, t), t) for t in TABLES])


@query(f"""SELECT 'dbo' AS schema_name, table_name, column_name, ordinal_position, data_type, CAST(NULL AS BIGINT) AS character_maximum_length, numeric_precision, numeric_scale, is_nullable, column_default, n_rows
FROM information_schema.columns JOIN ({" UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n_rows FROM {t}" for t in TABLES)}) ON t = table_name WHERE table_schema = 'main'""")
def schema_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of all tables, with the tables' rows."""
    found = {t: table(spark, sf_dir, t) for t in TABLES}
    counts = reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t, df in found.items()])
    return audit_columns(found).join(counts, "table_name").select(*[c.split()[0] for c in COLUMNS.split(", ")], "n_rows")
