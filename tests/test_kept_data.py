"""Rows and tables that must not be lost: failing swaps, names that fall together, ties, maps, events without documents."""

import pytest
from pyspark.sql import functions as F

from tidewright.functions.naming import flat_name, held_names, parse_table, sanitized
from tidewright.operators import audit, changes
from tidewright.plans import migration
from tidewright.sources import tables


@pytest.fixture
def source(spark, sf_dir):
    return {t: tables.table(spark, sf_dir, t) for t in ("region", "nation")}


@pytest.mark.parametrize("fails", ["__", "RENAME TO kept_a.t"])
def test_a_failing_swap_leaves_the_old_rows(spark, source, monkeypatch, fails):
    """The rename of the new table fails, or that of the old one."""
    spark.sql("CREATE DATABASE IF NOT EXISTS kept_a")
    assert tables.copy_table(source["region"], "kept_a.t")["status"] == "success"
    real, said = type(spark).sql, []

    def sql(self, text, *args, **kwargs):
        if text.startswith("ALTER") and fails in text.split(" RENAME")[0 if fails == "__" else -1] + (text if fails != "__" else "") and not said:
            said.append(text)
            raise RuntimeError("no rename")
        return real(self, text, *args, **kwargs)

    monkeypatch.setattr(type(spark), "sql", sql)
    assert tables.copy_table(source["nation"], "kept_a.t")["status"] == "failed" and said
    monkeypatch.undo()
    assert spark.table("kept_a.t").count() == 5 and [t.name for t in spark.catalog.listTables("kept_a") if not t.isTemporary] == ["t"]
    assert tables.copy_table(source["nation"], "kept_a.t")["status"] == "success" and spark.table("kept_a.t").count() == 25


def test_names_that_fall_together(spark, source, tmp_path):
    assert held_names(["a_b", "a-b", "A b"], sanitized) == {"a_b": "a_b", "A b": "a_b_2", "a-b": "a_b_3"}
    assert held_names(["Sales.T", "dbo.T", "t"], lambda n: flat_name(*parse_table(n))) == {"t": "t", "Sales.T": "sales_t", "dbo.T": "t_2"}
    got = migration.migrate(spark, {"Orders": source["region"], "orders": source["nation"], "Sales.Orders": source["region"]}, "kept_b", replace=True)
    assert {r.object_name: r.rows_migrated for r in got.collect()} == {"Orders": 5, "orders": 25, "Sales.Orders": 5}
    assert {t.name: spark.table(f"kept_b.{t.name}").count() for t in spark.catalog.listTables("kept_b") if not t.isTemporary} == {"orders": 25, "orders_2": 5, "sales_orders": 5}
    docs = lambda *texts: spark.createDataFrame([(t,) for t in texts], "document string")
    moved = migration.migrate_documents(spark, {"a-b": docs('{"x": 1}'), "a_b": docs('{"y": 2}', '{"y": 3}')}, "kept_b")
    assert {r.collection_name: (r.table_name, r.rows) for r in moved.collect()} == {"a-b": ("a_b_2", 1), "a_b": ("a_b", 2)}
    assert spark.table("kept_b.a_b").columns == ["y"] and spark.table("kept_b.a_b_2").columns == ["x"]
    out = migration.export_documents(spark, {"T": source["region"], "t": source["nation"], "Sales.t": source["region"]}, str(tmp_path))
    assert {r.table_name: (r.collection_name, r.documents) for r in out.collect()} == {"dbo.T": ("t_2", 5), "dbo.t": ("t", 25), "Sales.t": ("sales_t", 5)}


def test_polls_keep_ties(spark):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-01"), (3, "2024-01-01"), (4, "2024-01-02")], "id int, day string").select("id", F.to_timestamp("day").alias("updated_at"))
    rest = changes.captured(df, after=("2024-01-01", 2), key="id").orderBy("seq").collect()
    assert [(r.id, r.op, r.seq.key) for r in rest] == [(3, "INSERT", 3), (4, "INSERT", 4)]
    assert changes.captured(df, key="id").count() == 4 and [r.id for r in changes.captured(df, after="2024-01-01").collect()] == [4]


def test_rows_with_maps_take_changes(spark):
    made = spark.sql("SELECT * FROM VALUES (1, map('a', 1), 1, 'INSERT'), (1, map('a', 2), 2, 'UPDATE'), (2, map('b', 1), 1, 'INSERT'), (2, map('c', 9), 1, 'INSERT'), (3, NULL, 5, 'INSERT') AS t(id, props, seq, op)")
    target = spark.sql("SELECT 1 AS id, map('z', 0) AS props UNION ALL SELECT 4, map('y', 1)")
    got = {r.id: r.props for r in changes.apply_changes(target, made, ["id"], ["seq"]).collect()}
    assert got == {1: {"a": 2}, 2: {"c": 9}, 3: None, 4: {"y": 1}}
    odd = made.withColumnRenamed("props", "a.b")
    assert changes.latest(odd, ["id"], ["seq"]).columns == ["id", "seq", "a.b", "op"]


def test_events_without_documents_are_set_aside(spark):
    event = lambda seq, kind, more="": f'{{"_id": {{"_data": "{seq}"}}, "operationType": "{kind}", "ns": {{"coll": "c"}}{more}}}'
    key, whole = ', "documentKey": {"_id": "k"}', ', "fullDocument": {"v": 1}'
    texts = [event("1", "insert", key + whole), event("2", "update", key), event("3", "delete", key), event("4", "delete"), event("5", "drop"), "{broken", "[]", None]
    df = spark.createDataFrame([(t,) for t in texts], "event string")
    assert sorted(r.seq for r in changes.document_changes(df, "event", "v:int").collect()) == ["1", "3"]
    got = [(r.seq, r.problem) for r in changes.told(df, "event", "v:int").filter("problem is not null").collect()]
    assert sorted(got, key=str) == sorted([("2", "no document"), ("4", "no key"), *[(None, "the event can't be read")] * 3], key=str)


def test_distinct_values_of_nested_types(spark):
    df = spark.sql("SELECT * FROM VALUES (array('a, b'), named_struct('x', 1, 'y', NULL), map('k', 1)), (array('a', 'b'), named_struct('x', NULL, 'y', 1), map('k', 2)), (array(NULL, 'a'), NULL, map('k', 1)), (array('a'), named_struct('x', 1, 'y', NULL), NULL) AS t(l, s, m)")
    got = {r.column_name: (r.n_rows, r.n_values, r.n_distinct) for r in audit.value_counts(df, "t").collect()}
    assert got == {"l": (4, 4, 4), "s": (4, 3, 2), "m": (4, 3, 2)}


def test_position_texts_keep_the_order_of_bytes(spark):
    log = spark.createDataFrame([(bytes([0, 9]), bytes([1]), 2, 7), (bytes([0, 10]), bytes([0]), 1, 8), (bytes([0, 10]), bytes([2]), 3, 8), (bytes([0, 10]), bytes([3]), 4, 9)], "`__$start_lsn` binary, `__$seqval` binary, `__$operation` int, id int")
    got = changes.log_changes(log).orderBy("seq").collect()
    assert [(r.seq, r.op, r.id) for r in got] == [("000901", "INSERT", 7), ("000A00", "DELETE", 8), ("000A03", "UPDATE", 9)]
    assert changes.log_bytes("000A03") == bytes([0, 10, 3])


def test_changes_by_filter_one_after_the_other(spark):
    """Against changes made one at a time, each to one row that agrees."""
    rows = [(i, f"n{i % 4}", float(i % 3)) for i in range(12)] + [(3, "n3", 0.0), (3, "n3", 0.0)]
    target = spark.createDataFrame(rows, "id int, name string, v double")
    made = [
        (1, "UPDATE", {"id": "5"}, (5, "new", 1.0)), (2, "UPDATE", {"id": "5"}, (5, "newer", 2.0)), (3, "DELETE", {"id": "6"}, None), (4, "UPDATE", {"id": "77"}, (77, "added", 0.5)),
        (5, "INSERT", {"id": "5"}, (5, "twice", 9.0)), (6, "DELETE", {"id": "3"}, None), (7, "UPDATE", {}, (88, "no filter", None)), (8, "DELETE", {}, None),
        (9, "UPDATE", {"name": "n2", "v": "1.0"}, (10, "both", 4.0)), (10, "DELETE", {"name": "none", "v": "0.0"}, None), (11, "DELETE", {"nothing": "1"}, None),
    ]
    df = spark.createDataFrame(made, "seq int, op string, filter map<string,string>, data struct<id:int,name:string,v:double>")
    want = list(rows)
    for _, op, by, data in made:
        at = None if op == "INSERT" or not by else next((i for i, r in enumerate(want) if all({"id": str(r[0]), "name": r[1], "v": str(r[2])}.get(k) == v for k, v in by.items())), None)
        if at is not None:
            del want[at]
        if op != "DELETE":
            want.append(data)
    got = sorted(map(tuple, changes.apply_by_filter(target, df, ["seq"]).collect()), key=str)
    assert got == sorted(want, key=str)
    assert sorted(map(tuple, changes.apply_by_filter(target, df.filter("seq > 99"), ["seq"]).collect())) == sorted(rows)
