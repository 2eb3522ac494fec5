import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions import naming, types
from tidewright.functions import scalars as s
from tidewright.operators import audit, changes, documents, hierarchy, relational
from tidewright.sources import tables
from tidewright.streaming import capture


@pytest.mark.parametrize(
    ("source", "name", "sizes", "want"),
    [
        ("mssql", "nvarchar", (-1,), "string"), ("mssql", "nvarchar", (100,), "varchar(100)"), ("mssql", "decimal", (None, 10, 2), "decimal(10,2)"), ("mssql", "tinyint", (), "smallint"),
        ("mysql", "tinyint", (), "tinyint"), ("postgresql", "uuid", (), "string"), ("postgresql", "int4", (), "int"), ("postgresql", "bool", (), "boolean"), ("mssql", "timestamp", (), "binary"),
        ("mysql", "timestamp", (), "timestamp_ntz"), ("postgresql", "timestamp with time zone", (), "timestamp"), ("mssql", "money", (), "decimal(19,4)"), ("mysql", "float", (), "float"), ("mssql", "float", (), "double"),
        ("mssql", "char", (400,), "char(255)"), ("mssql", "decimal", (None, 9, 0), "decimal(9,0)"), ("mssql", "no_such_type", (), "string"), ("postgresql", "bytea", (), "binary"),
    ],
)
def test_source_types(source, name, sizes, want):
    assert types.spark_type(source, name, *sizes).simpleString() == want


def test_target_types_and_ddl(spark):
    assert types.target_type(T.VarcharType(20000), "mysql") == "VARCHAR(16383)"
    assert types.target_type(T.ArrayType(T.LongType()), "postgresql") == "JSONB" and types.target_type(T.StringType(), "mssql") == "NVARCHAR(MAX)"
    assert types.target_type(T.DecimalType(10, 2), "postgresql") == "NUMERIC(10,2)"
    text = types.create_table(naming.table_name("dbo", "Users", "postgresql"), T.StructType.fromDDL("Id int, Name varchar(100)"), "postgresql", ("Id",))
    assert text.splitlines()[0] == 'CREATE TABLE "public"."users" (' and '"id" INTEGER NOT NULL' in text and 'PRIMARY KEY ("id")' in text
    with pytest.raises(ValueError):
        types.target_type(T.LongType(), "oracle")


def test_names():
    assert naming.table_name("Sales", "Orders", "mysql") == "`sales_orders`" and naming.table_name("dbo", "Orders", "mysql") == "`orders`"
    assert naming.table_name("", "Orders", "mssql") == "[dbo].[orders]" and naming.table_name("Sales", "Orders", "mongodb") == "sales_orders"
    assert naming.parse_table("[Sales].[Order]") == ("Sales", "Order") and naming.parse_table("x") == ("dbo", "x")
    assert naming.unique_names(["a b", "a_b", "1x", "É-u"]) == ["a_b", "a_b_2", "f_1x", "é_u"]


@given(st.text(max_size=20))
def test_sanitising_settles(name):
    once = naming.sanitized(name)
    assert naming.sanitized(once) == once and "-" not in once


def test_jdbc_urls():
    assert tables.jdbc_options("postgresql", "h", "d", "u", "p")["url"] == "jdbc:postgresql://h:5432/d"
    assert "integratedSecurity" in tables.jdbc_options("mssql", "h", "d")["url"] and "h\\i;" in tables.jdbc_options("mssql", "h", "d", instance="i")["url"]
    with pytest.raises(ValueError):
        tables.jdbc_options("sqlite", "h", "d")


def test_scalars(spark):
    row = spark.range(1).select(
        s.leading_zeros(F.lit(42)).alias("z"), s.status_text(F.lit(9), s.DOCUMENT_STATUS).alias("st"), s.visible_length(F.lit("ab  ")).alias("n"), s.path_parent(F.lit("/1/2/")).alias("p"),
        s.path_parent(F.lit("/")).alias("root"), s.accounting_start(F.lit(2003)).alias("a"), s.accounting_end(F.lit(2003)).alias("e"), s.fiscal_year(F.lit("2003-07-01").cast("date")).alias("fy"),
    ).first()
    assert spark.range(1).select(s.leading_zeros(F.lit(123456789)).alias("z"), s.cut_text(F.lit("abcdef"), 4).alias("c")).first() == ("123456789", "abcd")
    assert (row.z, row.st, row.n, row.p, row.root, row.fy) == ("00000042", "** Invalid **", 2, "/1/", None, 2004)
    assert str(row.a) == "2003-07-01 00:00:00" and str(row.e) == "2004-06-30 23:59:59.998000"


def test_documents(spark):
    df = spark.createDataFrame([(1, {"b": 1, "c": {"d": "x"}}, [1, 2], bytearray(b"\x0a\xff"), None)], "Id int, a struct<b:int,c:struct<d:string>>, l array<int>, x binary, e struct<>")
    flat = documents.flattened(df)
    assert flat.columns == ["id", "a_b", "a_c_d", "l", "x"] and flat.first()[:4] == (1, 1, "x", "[1,2]")
    assert tables.to_documents(df.select("Id", "x"), lower=True).first()[0] == '{"id":1,"x":"0aff"}'
    texts = ['{"a": 1, "b": 1, "c": null, "d": true}', '{"a": 2, "b": 2.5, "c": null, "d": "no"}', '{"a": null, "e": [1, "x"]}', None, "{broken"]
    got = {r.field: (r.inferred, r.n_documents) for r in documents.infer_fields(spark.createDataFrame([(t,) for t in texts], "d string"), "d").collect()}
    assert got == {"a": ("BIGINT", 3), "b": ("DOUBLE", 2), "c": ("STRING", 2), "d": ("STRING", 2), "e": ("ARRAY", 1)}


def test_hierarchies(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 4)], "p long, c long")
    start = spark.createDataFrame([(1, 1)], "origin long, node long")
    assert sorted((r.node, r.level) for r in hierarchy.walk(start, edges, ("p", "c")).collect()) == [(1, 0), (2, 1), (3, 2), (4, 1)]
    with pytest.raises(RecursionError):
        hierarchy.walk(start, spark.createDataFrame([(1, 2), (2, 1)], "p long, c long"), ("p", "c"), most=5)


OPS = st.lists(st.tuples(st.integers(1, 3), st.sampled_from(["INSERT", "UPDATE", "DELETE"]), st.integers(0, 9)), max_size=12)


def test_applying_changes(spark):
    target = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    made = [(1, 1, "UPDATE", 11), (1, 2, "DELETE", None), (1, 3, "INSERT", 12), (2, 4, "DELETE", None), (3, 5, "UPDATE", 30), (4, 6, "DELETE", None)]
    log = spark.createDataFrame(made, "k int, seq int, op string, v int")
    once = changes.apply_changes(target, log, ["k"], ["seq"])
    assert sorted(map(tuple, once.collect())) == [(1, 12), (3, 30)]
    assert sorted(map(tuple, changes.apply_changes(once, log, ["k"], ["seq"]).collect())) == [(1, 12), (3, 30)]
    raw = spark.createDataFrame([(1, b"\x01", b"\x01", 7), (3, b"\x02", b"\x01", 8), (4, b"\x02", b"\x02", 9), (2, b"\x03", b"\x01", 5)], "`__$operation` int, `__$start_lsn` binary, `__$seqval` binary, v int")
    assert [(r.op, r.v) for r in changes.log_changes(raw, b"\x01").orderBy("seq").collect()] == [("UPDATE", 9), ("INSERT", 5)]
    assert changes.change_time(T.StructType.fromDDL("created date, Updated timestamp")) == "Updated" and changes.change_time(T.StructType.fromDDL("a int")) is None


def test_audits(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 3)], "a int, b int")
    assert audit.key_candidate(df, ["b"]).first() == (3, 3, 0, True) and audit.key_candidate(df, ["a"]).first() == (3, 2, 1, False)
    assert audit.orphans(df, spark.createDataFrame([(1,)], "k int"), {"a": "k"}).count() == 1
    assert [(r.column_name, r.ordinal_position) for r in audit.audit_columns({"t": df}).collect()] == [("a", 1), ("b", 2)]


def test_copy(spark, sf_dir):
    spark.sql("create database if not exists copied")
    nation = tables.table(spark, sf_dir, "nation")
    assert tables.copy_table(nation, "copied.nation") == {"table_name": "nation", "status": "success", "rows_migrated": 25, "error": None}
    assert spark.table("copied.nation").count() == 25
    assert tables.copy_table(nation, "no_such_database.nation")["status"] == "failed"
    # a copy that fails leaves what was there; one that succeeds replaces it
    broken = nation.withColumn("x", F.raise_error(F.lit("no")).cast("int"))
    assert tables.copy_table(broken, "copied.nation")["status"] == "failed" and spark.table("copied.nation").count() == 25
    assert tables.copy_table(nation.limit(3), "copied.nation")["rows_migrated"] == 3 and spark.table("copied.nation").count() == 3
    assert [t.name for t in spark.catalog.listTables("copied")] == ["nation"]


def test_jdbc_round_trip(spark, sf_dir):
    nation = tables.table(spark, sf_dir, "nation")
    options = {"url": "jdbc:derby:memory:trip;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "dbtable": "nation"}
    options.pop("dbtable")
    tables.write_jdbc(nation, options | {"batchsize": "1000"}, "nation", "overwrite")
    read = tables.read_jdbc(spark, options, "nation", ("n_nationkey", 0, 25, 4))
    assert read.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, read.filter("N_REGIONKEY = 1").collect())) == sorted(map(tuple, nation.filter("n_regionkey = 1").collect()))


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    schema = "k int, payload string"
    spark.createDataFrame([(1, '{"v": 1}'), (2, "{oops")], schema).write.parquet(f"{tmp_path}/in/1")
    seen = []

    def apply(batch, batch_id):
        good, bad = capture.split_changes(batch, "payload", "v int")
        seen.append((good.count(), bad.count()))

    run = lambda: capture.run_available(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), apply, f"{tmp_path}/ck")
    assert run()["rows"] == 2 and seen == [(1, 1)]
    assert run()["rows"] == 0 and seen == [(1, 1)]
    spark.createDataFrame([(3, '{"v": 3}')], schema).write.parquet(f"{tmp_path}/in/2")
    assert run()["rows"] == 1 and seen[-1] == (1, 0)


def test_inferred_types_come_from_the_values(spark):
    texts = ['{"zip": "02139", "ok": "true", "n": 12345678901234567890123, "o": {"a": {"b": 1}, "e": {}}, "l": [1], "m": 1}', '{"o": {"a": {"b": 2.5}}, "m": true, "_id": "x", "in": {"_id": 7}}', "[1]", "3", None, "{"]
    docs = spark.createDataFrame([(t,) for t in texts], "d string")
    got = {r.field: r.inferred for r in documents.infer_fields(docs, "d").collect()}
    assert got == {"zip": "STRING", "ok": "STRING", "n": "DECIMAL(38,0)", "o_a_b": "DOUBLE", "l": "ARRAY", "m": "STRING", "_id": "STRING", "in__id": "BIGINT"}
    fields = [(r.path, r.inferred) for r in documents.infer_fields(docs, "d").collect()]
    rows = documents.document_rows(docs, "d", fields).collect()
    assert len(rows) == 6 and rows[0].asDict() == {"_id": None, "in__id": None, "l": "[1]", "m": "1", "n": 12345678901234567890123, "o_a_b": 1.0, "ok": "true", "zip": "02139"}
    assert (rows[1].m, rows[1]["_id"], rows[1].in__id, rows[1].o_a_b) == ("true", "x", 7, 2.5) and set(rows[3]) == {None}
    assert documents.probe(docs, "d")[-1] == ("zip", "STRING")


def test_as_of_is_valid_at(spark):
    r = random.Random(3)
    at = lambda d: datetime(2000, 1, 1) + timedelta(days=d)
    periods = []
    for k in (1, 2, None):
        starts = sorted(r.sample(range(3000), 12))
        periods += [(k, at(a), at(b - 1) if n % 3 else at(a + 1), n) for n, (a, b) in enumerate(zip(starts, [*starts[1:], 4000], strict=True))]
        periods[-1] = (k, periods[-1][1], None, 99)
    facts = [(r.choice([1, 2, 3, None]), at(r.randrange(-50, 4000)), n) for n in range(300)]
    f, p = spark.createDataFrame(facts, "k int, t timestamp_ntz, n int"), spark.createDataFrame(periods, "k int, a timestamp_ntz, b timestamp_ntz, v int")
    want = sorted((n, v) for k, t, n in facts for k2, a, b, v in periods if k == k2 and k is not None and a <= t and (b is None or t <= b))
    for days in (30, 365, 100_000):
        assert sorted((x.n, x.v) for x in relational.as_of(f, p, ["k"], "t", "a", "b", days).filter("k is not null").collect()) == want
    assert sorted((x.n, x.v) for x in relational.valid_at(f, p, ["k"], "t", "a", "b").collect()) == want


def test_null_keys_are_keys(spark):
    target = spark.createDataFrame([(None, 1), (2, 2)], "k int, v int")
    log = spark.createDataFrame([(None, 1, "UPDATE", 5), (2, 2, "DELETE", None)], "k int, seq int, op string, v int")
    once = changes.apply_changes(target, log, ["k"], ["seq"])
    assert [tuple(x) for x in once.collect()] == [(None, 5)] == [tuple(x) for x in changes.apply_changes(once, log, ["k"], ["seq"]).collect()]


def test_sources_by_kind(spark):
    assert [changes.source_kind(c) for c in (["__$start_lsn", "__$operation"], ["id", "operation", "row_data"], ["event"], ["a"])] == ["log", "trigger", "stream", "poll"]
    polled = changes.captured(spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 2))], "k int, updated timestamp_ntz"), after="2024-01-01")
    assert [(r.k, r.op) for r in polled.collect()] == [(2, "INSERT")]
    with pytest.raises(ValueError):
        changes.captured(spark.range(1))
