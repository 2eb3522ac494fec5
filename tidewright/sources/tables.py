"""Reading tables, copying them with type-directed conversion, and writing to the shared folder."""

from __future__ import annotations

import tempfile
import threading
import uuid

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.retry import retry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Where that is unset, a local session gets a folder of its own; a cluster's executors would not share one, so there it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "") or ""
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return f"{spark._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system; nothing happens where there is none."""
    where, files = _held(spark, path)
    files.delete(where, True)


def _held(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder of the shared file system; none where there is no such folder."""
    where, files = _held(spark, path)
    return [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []


def rename(spark: SparkSession, path: str, to: str) -> bool:
    """Gives a folder another name, if no folder has it."""
    (where, files), there = _held(spark, path), _held(spark, to)[0]
    return not files.exists(there) and files.rename(where, there)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file of the shared file system, read by the driver."""
    where, files = _held(spark, path)
    stream = files.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in the shared file system, written by the driver; an error if it is there."""
    where, files = _held(spark, path)
    stream = files.create(where, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


class Written(threading.local):
    """Paths that cut() has written in this thread, in order: what one thread clears is never another one's."""

    def __init__(self):
        self.paths: list[str] = []

    def __len__(self) -> int:
        return len(self.paths)


WRITTEN = Written()


def cut(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: its lineage ends there, a lost executor costs no recomputation, and nothing is computed twice."""
    path = shared_path(df.sparkSession, "cut")
    WRITTEN.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, since: int) -> None:
    """Deletes what cut() wrote in this thread after the first `since` tables. Only for tables that nothing will read again."""
    while len(WRITTEN) > since:
        remove(spark, WRITTEN.paths.pop())


def ordered_scan(df: DataFrame, order: list[str] | None = None, as_text: tuple[str, ...] = ()) -> DataFrame:
    """The columns in ordinal order under lower-case names; those of types that a target lacks as text."""
    return df.select(*[(F.col(f"`{c}`").cast("string") if c in as_text else F.col(f"`{c}`")).alias(c.lower()) for c in order or df.columns])


def iso(column: Column, kind: T.DataType) -> Column:
    """Dates and times in ISO form; no fraction where it is zero."""
    if isinstance(kind, T.DateType):
        return F.date_format(column, "yyyy-MM-dd")
    whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(column, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def document_value(column: Column, kind: T.DataType, dates_only: bool = True) -> Column:
    """A relational value as a document holds it: decimals as doubles, bytes as lower-case hex, dates as ISO text, the rest unchanged."""
    if isinstance(kind, T.DecimalType):
        return column.cast("double")
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(column))
    if isinstance(kind, T.DateType) or not dates_only and isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return iso(column, kind)
    return column


def to_documents(df: DataFrame, lower: bool = False) -> DataFrame:
    """One JSON document a row, nulls kept."""
    fields = [document_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name.lower() if lower else f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("document"))


def jdbc_options(kind: str, host: str, database: str, user: str | None = None, password: str | None = None, port: int | None = None, instance: str | None = None) -> dict[str, str]:
    """Options of spark.read.format("jdbc") for the three relational servers."""
    if kind == "mssql":
        url = f"jdbc:sqlserver://{host}" + (f"\\{instance}" if instance else f":{port or 1433}") + f";databaseName={database};encrypt=true;trustServerCertificate=true" + ("" if user else ";integratedSecurity=true")
    elif kind in ("mysql", "postgresql"):
        url = f"jdbc:{kind}://{host}:{port or {'mysql': 3306, 'postgresql': 5432}[kind]}/{database}"
    else:
        raise ValueError(f"unsupported source: {kind}")
    return {"url": url, "fetchsize": "10000", "batchsize": "1000"} | ({"user": user, "password": password or ""} if user else {})


@retry(exceptions=(Py4JError, PySparkException))
def read_jdbc(spark: SparkSession, options: dict[str, str], name: str, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A server's table; partition: (column, lower, upper, parts) of a parallel read. The server is asked for the schema here, and asked again if it does not answer."""
    reader = spark.read.format("jdbc").options(**options).option("dbtable", name)
    if partition:
        column, lower, upper, parts = partition
        reader = reader.options(partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts))
    return reader.load()


def literal(value: object) -> str:
    """A value as SQL text."""
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def equal_ranges(spark: SparkSession, options: dict[str, str], name: str, column: str, parts: int) -> list[str]:
    """Conditions that part a server's table into ranges of about equally many rows, whatever the spread of its values.

    The server says which values stand at the borders, one small question each. Rows without
    a value are in the first range; rows of one value are never parted.
    """
    ask = lambda q: spark.read.format("jdbc").options(**options).option("query", q).load().first()
    n = ask(f"SELECT count({column}) AS n FROM {name}")[0]
    tail = "LIMIT 1 OFFSET {k}" if options["url"].startswith("jdbc:mysql") else "OFFSET {k} ROWS FETCH NEXT 1 ROWS ONLY"
    borders = sorted({ask(f"SELECT {column} AS v FROM {name} WHERE {column} IS NOT NULL ORDER BY {column} " + tail.format(k=n * i // parts))[0] for i in range(1, parts)}) if n >= parts else []
    if not borders:
        return ["1 = 1"]
    first, last = f"{column} < {literal(borders[0])} OR {column} IS NULL", f"{column} >= {literal(borders[-1])}"
    return [first, *[f"{column} >= {literal(a)} AND {column} < {literal(b)}" for a, b in zip(borders, borders[1:], strict=False)], last]


@retry(exceptions=(Py4JError, PySparkException))
def read_jdbc_evenly(spark: SparkSession, options: dict[str, str], name: str, column: str, parts: int) -> DataFrame:
    """A server's table, read by ranges of equally many rows at once."""
    properties = {k: v for k, v in options.items() if k != "url"}
    return spark.read.jdbc(options["url"], name, predicates=equal_ranges(spark, options, name, column, parts), properties=properties)


def drop_table(spark: SparkSession, target: str) -> str:
    """Drops a table; whether there was one."""
    there = spark.catalog.tableExists(target)
    spark.sql(f"DROP TABLE IF EXISTS {target}")
    return "success" if there else "none"


def write_jdbc(df: DataFrame, options: dict[str, str], name: str, mode: str = "append") -> None:
    """Rows into a server's table, in batches of the options' batchsize."""
    df.write.format("jdbc").options(**options).option("dbtable", name).mode(mode).save()


def beside(target: str) -> str:
    """A new name in the database of the table `target`."""
    return ".".join(f"`{p}`" for p in f"{target.replace('`', '')}__{uuid.uuid4().hex[:8]}".split("."))


def swap_in(spark: SparkSession, made: str, target: str) -> None:
    """Puts the table `made` in the place of target. The old rows are set aside and dropped last: if the new ones can't take the name, the old ones get it back."""
    aside = beside(target)
    spark.sql(f"ALTER TABLE {target} RENAME TO {aside}")
    try:
        spark.sql(f"ALTER TABLE {made} RENAME TO {target}")
    except Exception:
        spark.sql(f"ALTER TABLE {aside} RENAME TO {target}")
        raise
    spark.sql(f"DROP TABLE {aside}")


def copy_table(df: DataFrame, target: str, mode: str = "overwrite", binary_as_hex: bool = False) -> dict:
    """Writes df as a catalog table, names in lower case; the result row of the copy.

    overwrite: the rows are written under a new name, and the table is swapped for them
    when all are there: a copy that fails leaves the table as it was.
    """
    spark, name, made = df.sparkSession, target.split(".")[-1].strip("`"), beside(target)
    try:
        columns = [(F.hex(f"`{f.name}`") if binary_as_hex and isinstance(f.dataType, T.BinaryType) else F.col(f"`{f.name}`")).alias(f.name.lower()) for f in df.schema]
        observed = Observation()
        rows = df.select(*columns).observe(observed, F.count(F.lit(1)).alias("rows"))
        if mode == "overwrite" and spark.catalog.tableExists(target):
            try:
                rows.write.saveAsTable(made)
                swap_in(spark, made, target)
            finally:
                spark.sql(f"DROP TABLE IF EXISTS {made}")
        else:
            rows.write.mode(mode).saveAsTable(target)
        return {"table_name": name, "status": "success", "rows_migrated": observed.get["rows"], "error": None}
    except Exception as e:  # one table's failure is a row of the report
        return {"table_name": name, "status": "failed", "rows_migrated": 0, "error": str(e)[:500]}
