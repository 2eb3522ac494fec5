import json

import pytest
from pyspark.sql import functions as F

from tidewright.operators.changes import fold_events
from tidewright.plans import feeds
from tidewright.sources.tables import listed, table


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "feeds")


def held(spark, folder, feed, columns=("user_id", "event_id", "value")):
    return sorted(map(tuple, feeds.keyed_table(spark, folder, feed.source, feed.table).select(*columns).collect()))


@pytest.fixture
def events(spark, sf_dir):
    """With ties: whole days share a time."""
    return table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz")).filter("event_id < 400").cache()


def want(events, kind):
    if kind == "poll":
        return sorted(map(tuple, events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("m")).select("user_id", "m.event_id", "m.value").collect()))
    order = events if kind == "log" else events.withColumn("ts", F.col("event_id"))
    return sorted(map(tuple, fold_events(order).select("user_id", "event_id", "value").collect()))


@pytest.mark.parametrize("n", range(4))
def test_runs_that_stop_anywhere_go_on(spark, events, folder, monkeypatch, n):
    """The run stops when a batch's rows are written but not its entry; what it wrote is never read."""
    feed = feeds.event_feeds(events)[n]
    real, fails = feeds.Ledger.commit, {1, 3}

    def commit(self, entry, seen=[]):  # noqa: B006
        seen.append(entry.batch)
        if len(seen) in fails:
            raise OSError("stopped")
        real(self, entry)

    monkeypatch.setattr(feeds.Ledger, "commit", commit)
    states = []
    for _ in range(12):
        states += [(r.batch, r.status, r.n_changes) for r in feeds.run_feeds(spark, [feed], folder, 150, 1, 4).collect()]
    assert [s[1] for s in states].count("failed") == 2
    assert [s[0] for s in states if s[1] == "success"] == list(range(len(states) - 2)) and len(states) > 4
    assert sum(s[2] for s in states if s[1] == "success") == events.count()
    assert held(spark, folder, feed) == want(events, feed.source)
    assert feeds.apply_batch(feed, folder) is None  # nothing is left, and nothing changes
    gone = feeds.vacuum(spark, folder, feed.source, feed.table, keep=1)
    assert len(gone) >= 2 and held(spark, folder, feed) == want(events, feed.source)


def test_untouched_files_keep_their_names(spark, folder):
    rows = spark.range(1000).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v"))
    log = lambda *made: spark.createDataFrame([(bytes([n]), i.to_bytes(2), op, k, v) for i, (n, op, k, v) in enumerate(made)], "`__$start_lsn` binary, `__$seqval` binary, `__$operation` int, k long, v string")
    feed = feeds.Feed("s", "t", log((1, 4, 7, "seven"), (1, 1, 8, None), (2, 2, 5000, "new")), ("k",))
    feeds.load(feed, rows, folder, buckets=16)
    before = {f for df in [feeds.keyed_table(spark, folder, "s", "t")] for f in df.inputFiles()}
    entry = feeds.apply_batch(feed, folder)
    after = set(feeds.keyed_table(spark, folder, "s", "t").inputFiles())
    assert (entry.n_changes, entry.n_put, entry.n_deleted) == (3, 2, 1)
    assert len(before - after) <= 3 and len(before & after) >= 13
    got = {r.k: r.v for r in feeds.keyed_table(spark, folder, "s", "t").collect()}
    assert got == {k: str(k) for k in range(1000) if k not in (7, 8)} | {7: "seven", 5000: "new"}
    # a bucket without rows, and a table that is emptied
    every = feeds.Feed("s", "t", log(*[(9, 1, k, None) for k in got]), ("k",))
    feeds.apply_batch(every, folder)
    assert feeds.keyed_table(spark, folder, "s", "t").count() == 0 and feeds.keyed_table(spark, folder, "s", "t").columns == ["k", "v"]


def test_each_table_has_its_position(spark, folder):
    made = lambda *rows: spark.createDataFrame(rows, "id long, at string, v string").select("id", F.to_timestamp_ntz("at").alias("updated_at"), "v")
    a = feeds.Feed("shop", "a", made((1, "2024-01-05", "x"), (2, "2024-01-05", "y")), ("id",), tie="id")
    b = feeds.Feed("shop", "b", made((1, "2024-01-01", "x")), ("id",), tie="id")
    feeds.run_feeds(spark, [a, b], folder, buckets=2)
    # a row older than the other table's position, one tied with its own, and one of a later microsecond
    a = feeds.Feed("shop", "a", made((1, "2024-01-05", "x"), (2, "2024-01-05", "y"), (3, "2024-01-05", "z"), (4, "2024-01-05 00:00:00.000001", "w")), ("id",), tie="id")
    b = feeds.Feed("shop", "b", made((1, "2024-01-01", "x"), (2, "2024-01-02", "y")), ("id",), tie="id")
    report = {r.table_name: r for r in feeds.run_feeds(spark, [a, b], folder, buckets=2).collect()}
    assert (report["a"].n_changes, report["b"].n_changes) == (2, 1)
    assert json.loads(report["a"].position) == {"seq": {"at": "2024-01-05T00:00:00.000001", "key": 4}}
    assert held(spark, folder, a, ("id", "v")) == [(1, "x"), (2, "y"), (3, "z"), (4, "w")] and held(spark, folder, b, ("id", "v")) == [(1, "x"), (2, "y")]


def test_a_second_writer_is_refused(spark, folder):
    feed = feeds.Feed("s", "t", spark.range(0).select("id", F.lit(None).cast("timestamp_ntz").alias("updated_at")), ("id",))
    entry = feeds.load(feed, spark.range(3), folder, buckets=2)
    with pytest.raises(RuntimeError):
        feeds.Ledger(spark, folder).commit(entry)
    assert [n for n in listed(spark, f"{folder}/ledger/s/t")] == ["000000000000"]
    with pytest.raises(ValueError):
        feeds.keyed_table(spark, folder, "s", "none")


def test_broken_changes_are_set_aside_once(spark, folder):
    event = lambda seq, kind, key, v=None: json.dumps({"_id": {"_data": seq}, "operationType": kind, "ns": {"coll": "c"}, "documentKey": {"_id": key}} | ({"fullDocument": {"k": key, "v": v}} if v else {}))
    rows = [event("1", "insert", "a", 1), "{broken", event("2", "update", "a"), event("3", "drop", "a"), None, event("4", "insert", "b", 2)]
    df = lambda r: spark.createDataFrame([(e,) for e in r], "event string")
    feed = feeds.Feed("m", "c", df(rows), ("k",), "k string, v int")
    first = feeds.apply_batch(feed, folder, buckets=2)
    assert (first.n_put, first.n_aside, first.n_changes) == (2, 3, 5)
    more = feeds.Feed("m", "c", df([*rows, event("5", "delete", "a"), "worse"]), ("k",), "k string, v int")
    second = feeds.apply_batch(more, folder, buckets=2)
    assert (second.n_put, second.n_deleted, second.n_aside) == (0, 1, 1)
    assert held(spark, folder, feed, ("k", "v")) == [("b", 2)]
    got = [(r.batch, r.raw and r.raw[:7], r.problem) for r in feeds.set_aside(spark, folder, "m", "c").collect()]
    assert sorted(got, key=str) == sorted([(0, "{broken", "the event can't be read"), (0, None, "the event can't be read"), (0, '{"_id":', "no document"), (1, "worse", "the event can't be read")], key=str)
    assert feeds.apply_batch(more, folder) is None


def test_a_failing_feed_does_not_stop_the_others(spark, events, folder):
    bad = feeds.Feed("x", "t", spark.range(3), ("id",))
    good = feeds.event_feeds(events)[1]
    report = {r.source: (r.status, r.error) for r in feeds.run_feeds(spark, [bad, good], folder, buckets=2).collect()}
    assert report["x"][0] == "failed" and "when a row changed" in report["x"][1] and report["log"] == ("success", None)


def test_a_load_starts_where_the_source_stands(spark, folder):
    """Rows that the full load has are not captured again; tables that appear later are loaded, the others take their changes."""
    made = lambda *rows: spark.createDataFrame(rows, "id long, at string, v string").select("id", F.to_timestamp_ntz("at").alias("updated_at"), "v")
    now = made((1, "2024-01-05", "x"), (2, "2024-01-06", "y"))
    feed = lambda name, rows: feeds.Feed("shop", name, rows, ("id",), tie="id")
    listed_of = lambda report: sorted((r.table_name, r.batch, r.n_changes, r.n_put) for r in report.collect())
    assert listed_of(feeds.sync_feeds(spark, {"a": (feed("a", now), now)}, folder, buckets=2)) == [("a", 0, 0, 2)]
    more = made((1, "2024-01-05", "x"), (2, "2024-01-07", "z"), (3, "2024-01-06", "w"))
    assert listed_of(feeds.sync_feeds(spark, {"a": (feed("a", more), more), "b": (feed("b", now), now)}, folder, buckets=2)) == [("a", 1, 2, 2), ("b", 0, 0, 2)]
    assert held(spark, folder, feed("a", now), ("id", "v")) == [(1, "x"), (2, "z"), (3, "w")]
    assert listed_of(feeds.sync_feeds(spark, {"a": (feed("a", more), more)}, folder, buckets=2)) == []


@pytest.mark.parametrize("n", range(4))
@pytest.mark.parametrize("far_off", [False, True])
def test_a_batch_ends_at_the_same_position_by_ranges(spark, events, folder, monkeypatch, n, far_off):
    """Batches of a sample and several ranges have the counts and positions that sorting all changes tells, also when the sample is far off."""
    feed = feeds.event_feeds(events)[n]
    seqs = [r.p for r in feeds.feed_changes(feed).orderBy("seq").select(F.to_json(F.struct("seq"), feeds.TIMES).alias("p")).collect()]
    want, at = [], 0
    while at < len(seqs):
        last = seqs[min(at + 170, len(seqs)) - 1]
        end = max(i for i, p in enumerate(seqs) if p == last) + 1
        want, at = [*want, (end - at, last)], end
    monkeypatch.setattr(feeds, "RANGE", 20)
    monkeypatch.setattr(feeds, "SAMPLE", len(seqs) // 2)
    if far_off:
        monkeypatch.setattr(feeds, "_surely", lambda feed, position, most: seqs[seqs.index(position) + 1 if position else 0])
    report = feeds.run_feeds(spark, [feed], folder, 170, None if not far_off else 2, 2).collect()
    assert [(r.n_changes, r.position) for r in report] == (want if not far_off else want[:2])


def test_no_task_sorts_a_whole_batch(spark):
    """The n-th position is met in ranges: no limit over all changes, ties and nulls kept apart."""
    changes = spark.range(300_000).select(F.when(F.col("id") % 10 == 0, 7).when(F.col("id") % 101 != 0, F.col("id")).alias("seq"))
    held = sorted(r.seq for r in changes.filter("seq is not null").collect())
    for n in (1, 9, 20_000, 30_009, 200_000, len(held)):
        assert json.loads(feeds.nth_position(changes, n)) == {"seq": held[n - 1]}
    assert feeds.nth_position(changes, len(held) + 1) is None


def test_an_event_is_parsed_once(spark, events):
    feed = feeds.event_feeds(events)[3]
    plan = feeds.feed_changes(feed).filter("seq > '0000000000000000100'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
