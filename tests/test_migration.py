import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions.retry import retry
from tidewright.operators import audit, catalog_audit, changes, documents, relational, scalar_queries
from tidewright.plans import migration
from tidewright.sources import tables


@pytest.fixture
def source(spark, sf_dir):
    return {t: tables.table(spark, sf_dir, t) for t in ("region", "nation")}


def listed(report):
    return sorted((r.step, r.object_name, r.status, r.rows_migrated) for r in report.collect())


def test_schema_only_then_data(spark, source):
    assert listed(migration.migrate(spark, source, "moved_a", "schema", replace=True)) == [("schema", "nation", "success", None), ("schema", "region", "success", None)]
    assert spark.table("moved_a.nation").count() == 0 and listed(migration.migrate(spark, source, "moved_a", "schema"))[0][2] == "exists"
    assert listed(migration.migrate(spark, source, "moved_a", "data")) == [("data", "nation", "success", 25), ("data", "region", "success", 5)]
    with pytest.raises(ValueError):
        migration.migrate(spark, source, "moved_a", "some")


def test_full_with_views(spark, source):
    views = {"far": "SELECT n_name FROM moved_b.nation WHERE n_regionkey = 1", "farther": "SELECT count(*) AS n FROM far", "broken": "SELECT nothing FROM nowhere"}
    report = migration.migrate(spark, source | {"Bad Name": source["region"].select(F.col("r_name").alias("x"), F.col("r_name").alias("X"))}, "moved_b", replace=True, views=views)
    got = {(s, o): st for s, o, st, _ in listed(report)}
    assert got[("data", "Bad Name")] == "failed" and got[("data", "nation")] == "success"  # one failure, the others go on
    assert (got[("view", "far")], got[("view", "farther")], got[("view", "broken")]) == ("success", "success", "failed")
    assert spark.table("farther").first().n == 5
    assert {(r.step, r.status): r.n for r in migration.totals(report).collect()} == {("data", "success"): 2, ("data", "failed"): 1, ("view", "success"): 2, ("view", "failed"): 1}
    spark.sql("CREATE OR REPLACE VIEW moved_b.kept AS SELECT n_name FROM moved_b.nation")
    assert "moved_b" in catalog_audit.list_databases(spark)
    assert [(r.table_name, r.row_count) for r in catalog_audit.audit_tables(spark, "moved_b").orderBy("table_name").collect()] == [("nation", 25), ("region", 5)]
    assert [r.view_name for r in catalog_audit.audit_views(spark, "moved_b").collect()] == ["kept"]


def test_sync_copies_new_tables_and_applies_changes(spark, source):
    migration.migrate(spark, {"region": source["region"]}, "moved_c", replace=True)
    made = spark.createDataFrame([(0, "NORTH", 1, "UPDATE"), (9, "NEW", 2, "INSERT"), (4, None, 3, "DELETE")], "r_regionkey int, r_name string, seq int, op string")
    once = lambda: migration.sync(spark, source, "moved_c", {"region": (made, ["r_regionkey"], ["seq"])})
    assert listed(once()) == [("changes", "region", "success", 5), ("new table", "nation", "success", 25)]
    want = sorted(map(tuple, spark.table("moved_c.region").collect()))
    assert (0, "NORTH") in want and (9, "NEW") in want and 4 not in [k for k, _ in want]
    assert listed(once()) == [("changes", "region", "success", 5)] and sorted(map(tuple, spark.table("moved_c.region").collect())) == want


def test_reports(spark, tmp_path):
    for name in ("run_1", "run_3", "run_2"):
        migration.save_report(spark.createDataFrame([("data", "t", "success", 1, None)], migration.REPORT), str(tmp_path), name)
    assert migration.newest_reports(spark, str(tmp_path), 2) == ["run_3", "run_2"]


def test_composite_foreign_keys_pair_by_place(spark):
    usage = [("s", "pk", "a", "x", 1), ("s", "pk", "a", "y", 2), ("s", "fk", "b", "ax", 1), ("s", "fk", "b", "ay", 2)]
    usage = spark.createDataFrame(usage, "constraint_schema string, constraint_name string, table_name string, column_name string, ordinal_position int")
    constraints = spark.createDataFrame([("s", "fk", "pk")], "constraint_schema string, constraint_name string, unique_constraint_name string")
    assert sorted((r.column_name, r.ref_table, r.ref_column) for r in catalog_audit.foreign_keys(usage, constraints).collect()) == [("ax", "a", "x"), ("ay", "a", "y")]


def test_document_stream(spark):
    events = [
        '{"_id": {"_data": "01"}, "operationType": "insert", "ns": {"coll": "c"}, "documentKey": {"_id": "k1"}, "fullDocument": {"_id": "k1", "v": 1}}',
        '{"_id": {"_data": "02"}, "operationType": "replace", "ns": {"coll": "c"}, "documentKey": {"_id": "k1"}, "fullDocument": {"v": 2}}',
        '{"_id": {"_data": "03"}, "operationType": "delete", "ns": {"coll": "c"}, "documentKey": {"_id": "k1"}}',
        '{"_id": {"_data": "04"}, "operationType": "drop", "ns": {"coll": "c"}}',
        "{broken", None,
    ]
    df = spark.createDataFrame([(e,) for e in events], "e string")
    read = lambda after=None: sorted((r.seq, r.op, r.key, r.data and r.data.v) for r in changes.document_changes(df, "e", "v:int", after).collect())
    assert read() == [("01", "INSERT", "k1", 1), ("02", "UPDATE", "k1", 2), ("03", "DELETE", "k1", None)] and read("02") == [("03", "DELETE", "k1", None)]


def test_key_columns():
    schema = T.StructType.fromDDL("Name string, ProductID int, Id int")
    assert changes.key_columns(schema) == ["Id"] and changes.key_columns(schema, ("productid", "NAME")) == ["ProductID", "Name"]
    with pytest.raises(ValueError):
        changes.key_columns(T.StructType.fromDDL("a int"))


def test_poll_loses_no_tie(spark):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-01"), (3, "2024-01-01"), (4, "2024-01-02")], "k int, d string")
    first = [r.k for r in relational.changes_after(df, "d", "k", F.lit(""), 2).collect()]
    rest = [r.k for r in relational.changes_after(df, "d", "k", F.lit("2024-01-01"), 9, F.lit(2)).collect()]
    assert first == [1, 2] and rest == [3, 4]


def test_sql_functions(spark):
    assert scalar_queries.register_functions(spark) == ["accounting_start_date", "document_status_text", "leading_zeros"]
    assert spark.sql("SELECT document_status_text(9) AS a, leading_zeros(7) AS b").first() == ("** Invalid **", "00000007")


def test_retry():
    calls = []

    @retry(base_delay=0, exceptions=(ValueError,))
    def sometimes(failures, error=ValueError):
        calls.append(1)
        if len(calls) <= failures:
            raise error
        return len(calls)

    assert sometimes(2) == 3
    calls.clear()
    with pytest.raises(ValueError):
        sometimes(9)
    assert len(calls) == 3
    calls.clear()
    with pytest.raises(KeyError):
        sometimes(9, KeyError)
    assert len(calls) == 1


def test_documents_move_with_skipped_and_failed(spark):
    docs = lambda *texts: spark.createDataFrame([(t,) for t in texts], "document string")
    report = migration.migrate_documents(spark, {"My-Things": docs('{"a": {"b": 1}}', '{"a": {"b": 2}, "c": [1]}'), "none": docs(), "bad": spark.range(1)}, "moved_d")
    got = {r.collection_name: (r.table_name, r.status, r.rows, r.error and r.error[:16]) for r in report.collect()}
    assert got["My-Things"] == ("my_things", "success", 2, None) and got["none"] == (None, "skipped", 0, "Empty collection") and got["bad"][1] == "failed"
    assert sorted(map(tuple, spark.table("moved_d.my_things").collect())) == [(1, None), (2, "[1]")]


def test_tables_become_collections(spark, source, tmp_path):
    report = migration.export_documents(spark, source | {"odd": source["region"].select(F.raise_error(F.lit("no")).alias("x"))}, str(tmp_path), "Sales")
    assert {r.table_name: (r.collection_name, r.status, r.documents) for r in report.collect()} == {"Sales.nation": ("sales_nation", "success", 25), "Sales.region": ("sales_region", "success", 5), "Sales.odd": ("", "failed", 0)}
    assert documents.read_collection(spark, f"{tmp_path}/sales_region").count() == 5


def test_audit_in_full(spark, source):
    spark.sql("CREATE DATABASE IF NOT EXISTS audited")
    spark.sql("CREATE TABLE IF NOT EXISTS audited.t (Id INT NOT NULL, Name VARCHAR(100), Price DECIMAL(10,2) DEFAULT 1.5) USING parquet")
    parts = catalog_audit.run_audit(spark, "audited")
    got = [(r.column_name.lower(), r.data_type, r.character_maximum_length, r.numeric_precision, r.numeric_scale, r.column_default) for r in parts["columns"].orderBy("ordinal_position").collect()]
    assert got == [("id", "INTEGER", None, 32, 0, None), ("name", "VARCHAR", 100, None, None, None), ("price", "DECIMAL(10,2)", None, 10, 2, "1.5")]
    assert {r.kind: r.total for r in parts["summary"].collect()} | {"total_routines": 0} == {"total_tables": 1, "total_columns": 3, "total_views": 0, "total_routines": 0}
    docs = spark.createDataFrame([('{"_id": 1, "x": {"y": "z"}}',)], "document string")
    parts = catalog_audit.run_audit(spark, "shop", {"things": docs})
    assert {r.kind: r.total for r in parts["summary"].collect()} == {"total_tables": 1, "total_columns": 2, "total_primary_keys": 1}


def test_index_audit(spark):
    rows = [("s", "t", "PRIMARY", 0, "id", 1), ("s", "t", "i", 1, "b", 2), ("s", "t", "i", 1, "a", 1), ("s", "u", "u_pkey", 0, "id", 1), ("s", "u", "one", 0, "c", 1), ("sys", "x", "y", 0, "c", 1)]
    found = catalog_audit.audit_indexes(spark.createDataFrame(rows, "table_schema string, table_name string, index_name string, non_unique int, column_name string, seq_in_index int"))
    assert [tuple(r) for r in found.collect()] == [("s", "t", "i", False, "a, b"), ("s", "u", "one", True, "c")]


def test_ddl_for_an_audit(spark):
    rows = [("Sales", "Users", "id", 1, "int", None, 10, 0, "NO", None), ("Sales", "Users", "name", 2, "nvarchar", 100, None, None, "YES", None), ("dbo", "Orders", "order-id", 1, "decimal", None, 10, 2, "YES", None)]
    columns = spark.createDataFrame(rows, audit.COLUMNS)
    keys = spark.createDataFrame([("Sales", "Users", "id")], "schema_name string, table_name string, column_name string")
    made = migration.schema_ddl(columns, keys, "mssql", "postgresql")
    assert [m[:2] for m in made] == [("sales", None), ("Sales", "Users"), ("dbo", "Orders")]
    assert made[0][2] == 'CREATE SCHEMA IF NOT EXISTS "sales"' and '"name" VARCHAR(100) NULL' in made[1][2] and 'PRIMARY KEY ("id")' in made[1][2] and '"order-id" NUMERIC(10,2) NULL' in made[2][2]
    assert [m[:2] for m in migration.schema_ddl(columns, keys, "mssql", "mysql")] == [("Sales", "Users"), ("dbo", "Orders")]
