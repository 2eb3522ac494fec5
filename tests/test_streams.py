import datetime as dt
import random
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from tidewright.operators.changes import latest
from tidewright.streaming import capture, late, polling

CHANGES = "k int, at timestamp, n int, v string"


def fold(rows):
    best = {}
    for k, at, n, v in rows:
        if k not in best or (at, n) > best[k][:2]:
            best[k] = (at, n, v)
    return sorted((k, *b) for k, b in best.items())


def feed(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(f"{folder}/in/{i}")
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def test_shuffled_and_repeated_changes_equal_the_fold(spark, tmp_path):
    r, day = random.Random(3), lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    rows = [(k, day(r.randrange(40)), n, f"{k}-{n}") for k in range(5) for n in range(8)]
    every = rows * 2
    r.shuffle(every)
    stream = feed(spark, tmp_path, [every[i::4] for i in range(4)])
    counts = late.keep_newest(spark, stream, ["k"], ["at", "n"], "900 days", f"{tmp_path}/out", f"{tmp_path}/offsets")
    passed = spark.read.parquet(f"{tmp_path}/out").filter("passed")
    assert fold(map(tuple, passed.select("k", "at", "n", "v").collect())) == fold(rows)
    assert counts["passed"] + counts["refused"] == len(every) and counts["batches"] >= 4
    # what passes for a key rises from batch to batch
    by_key = {}
    for x in passed.orderBy("batch").collect():
        assert x.k not in by_key or (x.at, x.n) > by_key[x.k]
        by_key[x.k] = (x.at, x.n)
    assert sorted(map(tuple, latest(passed.select("k", "at", "n", "v"), ["k"], ["at", "n"]).collect())) == fold(rows)


def test_state_expires_behind_the_watermark(spark, tmp_path):
    """A key's state goes when the watermark passes it; what is older still is dropped as late, so it can't come back."""
    day = lambda n: dt.datetime(2024, 1, n)
    stream = feed(spark, tmp_path, [[(1, day(1), 1, "a")], [(2, day(20), 1, "b")], [(3, day(21), 1, "c")], [(1, day(1), 0, "late"), (1, day(22), 0, "new"), (2, day(20), 0, "older")]])
    late.keep_newest(spark, stream, ["k"], ["at", "n"], "2 days", f"{tmp_path}/out", f"{tmp_path}/offsets")
    passed = [(x.k, x.v) for x in spark.read.parquet(f"{tmp_path}/out").filter("passed").orderBy("batch").collect()]
    assert sorted(passed) == [(1, "a"), (1, "new"), (2, "b"), (3, "c")]


def test_many_keys_cost_no_call_each(spark, tmp_path):
    """20,000 keys in two batches; the second has older, equal and newer positions, keys that differ in null alone, and whole numbers that a double can't hold beside nulls."""
    kind, big = "k long, j string, at timestamp, n long, v long", 2**60 + 1
    day = lambda n: dt.datetime(2024, 1, 1 + n)
    key = lambda i: (big + i if i % 5 else None, str(i) if i % 7 else None)
    rows = {key(i): i for i in range(20_000)}
    for b in range(2):
        made = [(*k, day(1 + (b and i % 3 - 1)), big, big + i if i % 2 else None) for k, i in rows.items()]
        spark.createDataFrame(made, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{b}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    began = time.monotonic()
    counts = late.keep_newest(spark, stream, ["k", "j"], ["at", "n"], "900 days", f"{tmp_path}/out", f"{tmp_path}/offsets")
    assert time.monotonic() - began < 60  # one call a key took minutes
    newer = [k for k, i in rows.items() if i % 3 == 2]
    assert (counts["passed"], counts["refused"]) == (len(rows) + len(newer), len(rows) - len(newer))
    got = spark.read.parquet(f"{tmp_path}/out").filter("passed").select("batch", "k", "j", F.dayofmonth("at"), "n", "v").collect()
    want = [(0, *k, 2, big, big + i if i % 2 else None) for k, i in rows.items()] + [(1, *k, 3, big, big + rows[k] if rows[k] % 2 else None) for k in newer]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_an_hour_that_comes_twice(spark, tmp_path):
    """In the zone's autumn the newer change is the older one by the clock."""
    zone, kind = spark.conf.get("spark.sql.session.timeZone"), "k int, at timestamp, n int"
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for n, at in enumerate(("05:50", "06:10", "05:55")):
            spark.createDataFrame([(1, f"2024-11-03T{at}:00Z", n)], "k int, at string, n int").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        late.keep_newest(spark, stream, ["k"], ["at", "n"], "1 day", f"{tmp_path}/out", f"{tmp_path}/offsets")
        assert [(x.n, x.passed) for x in spark.read.parquet(f"{tmp_path}/out").orderBy("batch").collect()] == [(0, True), (1, True), (2, False)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def server(path, rows):
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE IF NOT EXISTS t (id INTEGER, changed TEXT, v TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    db.close()


def test_polls_go_on_and_keep_ties(spark, tmp_path):
    """Three triggers, each a run of its own: two tables with positions of their own, rows of one time split between triggers, ranges of a few rows."""
    a, b = str(tmp_path / "a.db"), str(tmp_path / "b.db")
    tables = {n: {"connect": {"database": p}, "table": "t", "at": "changed", "key": "id"} for n, p in (("a", a), ("b", b))}
    got = []

    def keep(batch, n):
        got.append(sorted((r.table_name, r.d.id, r.d.v) for r in batch.select("table_name", F.from_json("data", "id int, changed string, v string").alias("d")).collect()))

    def run():
        polling.poll(spark, "sqlite3", tables, 3).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start().awaitTermination()
        return sorted(x for batch in got for x in batch)

    server(a, [(i, "2024-01-01", "first") for i in range(8)] + [(99, None, "never")])
    server(b, [])
    assert run() == [("a", i, "first") for i in range(8)]
    server(a, [(i, "2024-01-01", "tie") for i in range(8, 12)])
    server(b, [(1, "2023-05-05", "old")])
    assert run() == sorted([("a", i, "first") for i in range(8)] + [("a", i, "tie") for i in range(8, 12)] + [("b", 1, "old")])
    seen = run()
    server(b, [(0, "2023-05-06", "more")])
    assert sorted(set(run()) - set(seen)) == [("b", 0, "more")] and len(run()) == 14


def test_ranges_are_the_same_when_asked_again(tmp_path):
    path = str(tmp_path / "c.db")
    server(path, [(i % 50, f"2024-01-{1 + i % 9:02d}", "x") for i in range(500)])
    options = {"driver": "sqlite3", "tables": '{"t": {"connect": {"database": "%s"}, "table": "t", "at": "changed", "key": "id"}}' % path, "rowsperpartition": "60"}
    reader = polling.Polled(options)
    end = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), end)
    sizes = [sum(b.num_rows for b in reader.read(p)) for p in parts]
    assert sum(sizes) == 500 and max(sizes) <= 60 + 10 and len(parts) >= 7
    server(path, [(1, "2024-02-01", "later")])
    assert [sum(b.num_rows for b in reader.read(p)) for p in reader.partitions(reader.initialOffset(), end)] == sizes
    assert reader.partitions(end, end) == [] and reader.partitions({"t": None}, {"t": None}) == []
    with pytest.raises(ValueError):
        polling.Polled(options | {"tables": options["tables"].replace('"t", "at"', '"t; drop", "at"')})


def test_a_guarded_stream_goes_on_after_a_failure(spark, tmp_path):
    """The second batch fails when its bad rows are set aside already; run again, everything is there once, and counted."""
    batches = [[(1, "INSERT", '{"v": 1}'), (2, "UPDATE", "{broken"), (3, "DELETE", None)], [(4, "UPDATE", '{"v": 4}'), (5, "UPDATE", "nonsense")], [(6, "DELETE", '{"v": 6}')]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "id int, op string, p string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = lambda: spark.readStream.schema("id int, op string, p string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    failed = []

    def keep(batch, n):
        if n == 1 and not failed:
            failed.append(n)
            raise OSError("stopped")
        batch.select("id", "op", "data.v").write.mode("overwrite").parquet(f"{tmp_path}/applied/batch={n}")

    run = lambda: capture.apply_guarded(stream(), "p", "v int", keep, f"{tmp_path}/aside", f"{tmp_path}/offsets")
    with pytest.raises(Exception, match="stopped"):
        run()
    counts = run()
    assert sorted((r.id, r.v) for r in spark.read.parquet(f"{tmp_path}/applied").collect()) == [(1, 1), (4, 4), (6, 6)]
    assert sorted((r.id, r.problem) for r in spark.read.parquet(f"{tmp_path}/aside").collect()) == [(2, "the payload can't be read"), (3, "no payload"), (5, "the payload can't be read")]
    assert counts[1] == {"n_changes": 2, "n_failed": 1, "n_insert": 0, "n_update": 1, "n_delete": 0} and counts[2]["n_delete"] == 1
