"""Servers as catalogs and even ranges (Derby stands for one), and tables moved at once."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from tidewright.operators import catalog_audit
from tidewright.plans import migration
from tidewright.sources import tables

DERBY = {"url": "jdbc:derby:memory:served;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def test_audit_of_a_server_equals_that_of_the_tables(spark, sf_dir):
    names = ("region", "nation", "supplier")
    held = {t: tables.table(spark, sf_dir, t) for t in names}
    for t, df in held.items():
        tables.write_jdbc(df, DERBY, f"SHOP.{t}" if t == "region" else f"SHOP.{t}", "overwrite")
    catalog_audit.register_server(spark, "shop_server", DERBY)
    parts = catalog_audit.audit_server(spark, "shop_server", "SHOP")
    assert sorted((r.table_name, r.row_count) for r in parts["tables"].collect()) == sorted((t, df.count()) for t, df in held.items())
    own = catalog_audit.audit_columns(held, "shop")
    pick = ("schema_name", "table_name", "column_name", "ordinal_position", "data_type", "numeric_precision")
    assert sorted(map(tuple, parts["columns"].select(*pick).collect()), key=str) == sorted(map(tuple, own.select(*pick).collect()), key=str)
    # the server counts; no row is sent
    plan = spark.table("shop_server.SHOP.NATION").groupBy().agg(F.count(F.lit(1)))._jdf.queryExecution().toString()
    assert "PushedAggregates: [COUNT(*)]" in plan or "PushedAggregates: [COUNT(1)]" in plan


@pytest.mark.parametrize("kind", ["number", "text"])
def test_even_ranges_of_a_skewed_key(spark, kind):
    """Half of the keys lie in one hundredth of the range."""
    key = F.when(F.col("id") < 1000, F.col("id")).otherwise(F.col("id") * 100)
    rows = spark.range(2000).select((key if kind == "number" else F.lpad(key.cast("string"), 9, "0")).alias("K"), F.col("id").alias("V"))
    # Derby takes no null text from Spark
    rows = rows.union(spark.sql("SELECT CAST(NULL AS BIGINT), 7L" if kind == "number" else "SELECT '000000500', 7L"))
    name = f"SKEWED_{kind}".upper()
    tables.write_jdbc(rows, DERBY | {"createTableColumnTypes": "K VARCHAR(20)"} if kind == "text" else DERBY, name, "overwrite")
    read = tables.read_jdbc_evenly(spark, DERBY, name, "K", 8)
    sizes = [r[0] for r in read.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 2001 and len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8
    assert sorted(map(tuple, read.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    even = tables.read_jdbc(spark, DERBY, name, ("V", 0, 2000, 8)).count()
    assert even == 2001 and tables.equal_ranges(spark, DERBY, name, "K", 1) == ["1 = 1"]


def test_ranges_of_few_values(spark):
    tables.write_jdbc(spark.sql("SELECT CAST(5 AS BIGINT) AS K FROM range(100)"), DERBY, "ONE_VALUE", "overwrite")
    assert tables.read_jdbc_evenly(spark, DERBY, "ONE_VALUE", "K", 4).count() == 100
    assert tables.literal("it's") == "'it''s'" and tables.literal(5) == "5"


def test_drop_table(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS dropped")
    tables.copy_table(spark.range(3), "dropped.t")
    assert tables.drop_table(spark, "dropped.t") == "success" and tables.drop_table(spark, "dropped.t") == "none"


def test_tables_moved_at_once(spark, sf_dir):
    """The same report as one after the other; a table that fails does not stop the others."""
    source = {t: tables.table(spark, sf_dir, t) for t in ("region", "nation", "supplier", "customer", "part")}
    source["bad"] = source["region"].select(F.raise_error(F.lit("no")).alias("x"))
    listed = lambda report: sorted((r.step, r.object_name, r.status, r.rows_migrated) for r in report.collect())
    one = listed(migration.migrate(spark, source, "moved_one", replace=True))
    four = listed(migration.migrate(spark, source, "moved_four", replace=True, workers=4))
    assert one == four and ("data", "bad", "failed", 0) in one and ("data", "customer", "success", 150) in one
    assert all(spark.table(f"moved_four.{t}").count() == df.count() for t, df in source.items() if t != "bad")


def test_one_late_table_is_cancelled_alone(spark):
    def sleep(batches):
        for b in batches:
            time.sleep(40)
            yield b

    slow = spark.range(1).mapInArrow(sleep, "id long")
    source = {"fast": spark.range(5).toDF("a"), "slow": slow, "other": spark.range(6).toDF("a")}
    began = time.monotonic()
    report = {r.object_name: (r.status, r.rows_migrated) for r in migration.migrate(spark, source, "moved_late", replace=True, workers=2, seconds=8).collect()}
    assert time.monotonic() - began < 35
    assert report["fast"] == ("success", 5) and report["other"] == ("success", 6) and report["slow"][0] == "failed"


def test_jobs_run_at_once_and_raise_apart(spark):
    gate = threading.Barrier(3, timeout=30)  # passes only if three run at a time

    def job(n):
        gate.wait()
        if n == 1:
            raise KeyError(n)
        return n

    began = time.monotonic()
    got = migration.together(spark, {str(n): lambda n=n: job(n) for n in range(3)}, workers=3)
    assert got["0"] == 0 and got["2"] == 2 and isinstance(got["1"], KeyError) and time.monotonic() - began < 30
