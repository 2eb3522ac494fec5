"""Change feeds: captured changes applied batch by batch to keyed tables, with a ledger of positions.

A keyed table lies in hash buckets of its key. A batch reads and writes the buckets that
its changes touch, into a folder of its own; files of the others stay as they are. The
ledger has one entry for each batch of a table: the position up to which its source
is done, which folder holds each bucket, where the changes that can't be applied were
set aside, and counts. An entry appears by one rename, so a batch and its position are
there together or not at all: a run that stops anywhere goes on from the last entry, and
what a stopped batch has written is never read. Every table has a position of its own.

On stores whose rename is no single step one writer a table must be ensured from outside.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changes import LOG_OPERATIONS, OP_SQL, apply_changes, change_time, later, latest, log_position, operation, source_kind, told, trigger_told
from ..sources.tables import WRITTEN, clear, cut, listed, read_text, remove, rename, shared_path, table, write_text
from .registry import query

#: Positions are kept as JSON; times to the microsecond.
TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
#: Rows of a feed that are looked at to tell about where a batch ends.
SAMPLE = 10_000
#: Positions that one task sorts to tell exactly.
RANGE = 100_000
REPORT = "source string, table_name string, batch long, status string, n_changes long, n_put long, n_deleted long, n_aside long, position string, error string"


@dataclass(frozen=True)
class Feed:
    """Where the changes of one table come from.

    rows: a log, the log that triggers fill, the events of a change stream (column event), or
    a table to poll, as source_kind() tells them apart. key: what tells rows of the table
    apart. fields: DDL of the payload, where there is one. tie: the column that orders rows
    of one change time in a polled table.
    """

    source: str
    table: str
    rows: DataFrame
    key: tuple[str, ...]
    fields: str = ""
    tie: str | None = None


@dataclass(frozen=True)
class Entry:
    """A batch of a table in the ledger. folders: by bucket, the folder of its rows; a bucket without rows has none."""

    source: str
    table: str
    batch: int
    position: str | None
    key: tuple[str, ...]
    buckets: int
    schema: str
    folders: dict[str, str] = field(default_factory=dict)
    aside: str | None = None
    n_changes: int = 0
    n_put: int = 0
    n_deleted: int = 0
    n_aside: int = 0


class Ledger:
    """The entries of all tables under a folder: one small file for each batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _at(self, source: str, name: str) -> str:
        return f"{self.folder}/ledger/{source}/{name}"

    def newest(self, source: str, name: str) -> Entry | None:
        entries = sorted(n for n in listed(self.spark, self._at(source, name)) if n.isdigit())
        return self.entry(source, name, int(entries[-1])) if entries else None

    def entry(self, source: str, name: str, batch: int) -> Entry:
        read = json.loads(read_text(self.spark, f"{self._at(source, name)}/{batch:012d}"))
        return Entry(**read | {"key": tuple(read["key"])})

    def commit(self, entry: Entry) -> None:
        """Makes the batch the newest one; an error if another run has made an entry of its number."""
        made = f"{self._at(entry.source, entry.table)}/_{uuid.uuid4().hex}"
        write_text(self.spark, made, json.dumps(asdict(entry)))
        if not rename(self.spark, made, f"{self._at(entry.source, entry.table)}/{entry.batch:012d}"):
            remove(self.spark, made)
            raise RuntimeError(f"batch {entry.batch} of {entry.source}.{entry.table} is there already")

    def entries(self, source: str, name: str) -> list[Entry]:
        return [self.entry(source, name, int(n)) for n in sorted(listed(self.spark, self._at(source, name))) if n.isdigit()]


def bucket_of(key: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in key]), F.lit(buckets)).cast("int")


def _data(folder: str, source: str, name: str) -> str:
    return f"{folder}/data/{source}/{name}"


def _write(rows: DataFrame, folder: str, entry: Entry) -> dict[str, str]:
    """Writes rows by bucket into a new folder; the folders by bucket."""
    made = f"{_data(folder, entry.source, entry.table)}/{entry.batch:012d}-{uuid.uuid4().hex[:8]}"
    rows.withColumn("__bucket", bucket_of(entry.key, entry.buckets)).repartition("__bucket").write.partitionBy("__bucket").parquet(made)
    return {n.removeprefix("__bucket="): f"{made}/{n}" for n in listed(rows.sparkSession, made) if n.startswith("__bucket=")}


def _read(spark: SparkSession, entry: Entry, folders: list[str]) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(entry.schema))
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def keyed_table(spark: SparkSession, folder: str, source: str, name: str) -> DataFrame:
    """The table's rows as of its newest batch."""
    entry = Ledger(spark, folder).newest(source, name)
    if entry is None:
        raise ValueError(f"no table {source}.{name}")
    return _read(spark, entry, list(entry.folders.values()))


def set_aside(spark: SparkSession, folder: str, source: str, name: str) -> DataFrame:
    """(batch, position, raw, problem): the changes of the table that could not be applied."""
    kept = [e.aside for e in Ledger(spark, folder).entries(source, name) if e.aside]
    kind = "batch long, position string, raw string, problem string"
    return spark.read.schema(kind).parquet(*kept) if kept else spark.createDataFrame([], kind)


def load(feed: Feed, rows: DataFrame, folder: str, buckets: int = 64, position: str | None = None) -> Entry:
    """Makes the table from rows, as batch 0. position: up to where rows has the feed's changes already; None: its changes are all still to come."""
    spark = rows.sparkSession
    entry = Entry(feed.source, feed.table, 0, position, feed.key, buckets, rows.schema.json())
    entry = replace(entry, folders=_write(rows, folder, entry))
    entry = replace(entry, n_put=_read(spark, entry, list(entry.folders.values())).count())
    Ledger(spark, folder).commit(entry)
    return entry


def feed_changes(feed: Feed) -> DataFrame:
    """(seq, op, raw, problem) and the row's columns: the changes of a feed of any kind. A change with a problem can't be applied."""
    kind, rows = source_kind(feed.rows.columns), feed.rows
    none = F.lit(None).cast("string")
    if kind == "log":
        op = F.element_at(F.create_map(*[F.lit(x) for kv in LOG_OPERATIONS.items() for x in kv]), F.col("`__$operation`"))
        own = [F.col(f"`{c}`") for c in rows.columns if not c.startswith("__$")]
        made = rows.filter("`__$operation` is null or `__$operation` != 3").select(log_position().alias("seq"), op.alias("op"), F.to_json(F.struct("*")).alias("raw"), F.when(op.isNull(), "unknown operation").when(log_position().isNull(), "no position").alias("problem"), *own)
    elif kind == "trigger":
        made = trigger_told(rows, feed.fields).select("seq", "op", "raw", "problem", "data.*")
    elif kind == "stream":
        read = told(rows, "event", feed.fields).filter("op is not null or problem is not null")
        columns = T.StructType.fromDDL(feed.fields)
        value = lambda f: F.coalesce(F.col(f"data.`{f.name}`"), F.col("key").cast(f.dataType)) if (f.name,) == feed.key else F.col(f"data.`{f.name}`")
        made = read.select("seq", "op", "raw", "problem", *[value(f).alias(f.name) for f in columns])
    else:
        at = change_time(rows.schema)
        if at is None:
            raise ValueError("no column tells when a row changed")
        seq = F.struct(F.col(f"`{at}`").alias("at"), *([F.col(f"`{feed.tie}`").alias("key")] if feed.tie else []))
        made = rows.select(seq.alias("seq"), F.lit("INSERT").alias("op"), none.alias("raw"), F.when(F.col(f"`{at}`").isNull(), "no position").alias("problem"), "*")
    missing = F.when(F.col("problem").isNotNull(), F.col("problem"))
    for k in feed.key:
        missing = missing.when(F.col(f"`{k}`").isNull(), "no key")
    return made.withColumn("problem", missing)


def _after(changes: DataFrame, feed: Feed, position: str | None) -> DataFrame:
    """The changes behind a position. A polled table is filtered by its own columns, which a scan can skip files by."""
    if position is None:
        return changes
    held = _held(position, changes)
    if source_kind(feed.rows.columns) == "poll":
        at = change_time(feed.rows.schema)
        later_rows = later(at, feed.tie, (held["at"], held["key"])) if feed.tie else F.col(f"`{at}`") > held["at"]
        return changes.filter(later_rows | F.col(f"`{at}`").isNull())
    # a change without a position is looked at in every batch, and set aside once
    return changes.filter((F.col("seq") > held) | F.col("seq").isNull())


def _held(position: str, changes: DataFrame) -> Column:
    """A position as a value."""
    return F.from_json(F.lit(position), T.StructType([T.StructField("seq", changes.schema["seq"].dataType)]), TIMES)["seq"]


def _told(seq: Column) -> Column:
    """A position as JSON."""
    return F.to_json(F.struct(seq.alias("seq")), TIMES)


def _upto(changes: DataFrame, position: str) -> DataFrame:
    """The changes up to a position, and those without one."""
    return changes.filter((F.col("seq") <= _held(position, changes)) | F.col("seq").isNull())


def _surely(feed: Feed, position: str | None, most: int) -> str | None:
    """A position that the next `most` changes hardly reach, by a sample of the rows; None: nothing can be left out."""
    share = SAMPLE / max(feed.rows.count(), 1)
    if share >= 1:
        return None
    sample = _after(feed_changes(replace(feed, rows=feed.rows.sample(share))), feed, position).filter("seq is not null")
    n = math.ceil(most * share + 4 * math.sqrt(most * share)) + 4
    # no more of the sample than the n smallest are kept by a task
    found, last = sample.select("seq").orderBy("seq").limit(n).agg(F.count("seq"), _told(F.max("seq"))).first()
    return last if found == n else None


def nth_position(changes: DataFrame, n: int) -> str | None:
    """The position of the n-th change, exactly; None if there are fewer. Ranges of positions are counted, and only the one where it lies is sorted; changes at one position are one row of it."""
    placed = changes.filter("seq is not null").select("seq")
    size = placed.count()
    if size < n:
        return None
    below, parts = 0, min(-(-size // RANGE), 1000)
    if parts > 1:
        # ranges are numbered in their order
        counted = placed.repartitionByRange(parts, "seq").groupBy(F.spark_partition_id().alias("i")).agg(F.count("seq"), _told(F.min("seq")), _told(F.max("seq")))
        for _, here, low, high in sorted(counted.collect()):
            if below + here >= n:
                placed = placed.filter((F.col("seq") >= _held(low, placed)) & (F.col("seq") <= _held(high, placed)))
                break
            below += here
    reached = placed.groupBy("seq").count().withColumn("upto", F.sum("count").over(Window.orderBy("seq")))
    return reached.filter(F.col("upto") >= n - below).agg(_told(F.min("seq"))).first()[0]


def apply_batch(feed: Feed, folder: str, most: int | None = None, buckets: int = 64) -> Entry | None:
    """Applies the next changes of a feed, all or about `most` of them (changes at one position stay together), and makes the ledger's entry; None if there are none."""
    spark, written = feed.rows.sparkSession, len(WRITTEN)
    ledger = Ledger(spark, folder)
    changes = feed_changes(feed)
    columns = [c for c in changes.columns if c not in ("seq", "op", "raw", "problem")]
    entry = ledger.newest(feed.source, feed.table)
    if entry is None:
        entry = Entry(feed.source, feed.table, -1, None, feed.key, buckets, changes.select(*[f"`{c}`" for c in columns]).schema.json())
    fresh = _after(changes, feed, entry.position)
    # what a change was read from is kept for those that can't be applied
    fresh = fresh.withColumn("raw", F.when(F.col("problem").isNotNull(), F.col("raw")))
    end = None if most is None else _surely(feed, entry.position, most)
    rest, fresh = fresh, cut(fresh if end is None else _upto(fresh, end))
    if most is not None:
        last = nth_position(fresh, most)
        if last is None and end is not None:  # the sample was far off
            fresh = cut(rest)
            last = nth_position(fresh, most)
        fresh = fresh if last is None else _upto(fresh, last)
    n_read, position, n_bad = fresh.agg(F.count("seq"), _told(F.max("seq")), F.count("problem")).first()
    after = replace(entry, batch=entry.batch + 1, position=position if n_read else entry.position, aside=None, n_changes=n_read, n_aside=0)
    if n_bad:
        after = _put_aside(spark, folder, after, fresh.filter("problem is not null"))
    if not n_read and not after.n_aside:
        clear(spark, written)
        return None
    folded = cut(latest(fresh.filter("problem is null").drop("raw", "problem"), list(feed.key), ["seq"]))
    # three rows for each bucket at most
    counts = folded.groupBy(bucket_of(entry.key, entry.buckets).alias("b"), F.col("op") == "DELETE").count().collect()
    touched = {str(b) for b, _, _ in counts}
    target = _read(spark, entry, [f for b, f in entry.folders.items() if b in touched])
    rows = apply_changes(target, folded, list(feed.key), ["seq"])
    folders = {b: f for b, f in entry.folders.items() if b not in touched} | (_write(rows, folder, after) if touched else {})
    after = replace(after, folders=folders, n_put=sum(n for _, gone, n in counts if not gone), n_deleted=sum(n for _, gone, n in counts if gone))
    ledger.commit(after)
    clear(spark, written)
    return after


def _put_aside(spark: SparkSession, folder: str, entry: Entry, bad: DataFrame) -> Entry:
    """The entry with the changes that can't be applied written to a folder of their own. One without a position is met in every batch: it counts the first time."""
    bad = bad.select(F.lit(entry.batch).cast("long").alias("batch"), F.when(F.col("seq").isNotNull(), F.to_json(F.struct("seq"), TIMES)).alias("position"), "raw", "problem", F.xxhash64("raw", "problem").alias("__h"))
    known = set_aside(spark, folder, entry.source, entry.table).filter("position is null").select(F.xxhash64("raw", "problem").alias("__h")).distinct()
    unplaced = bad.filter("position is null").dropDuplicates(["__h"]).join(known, "__h", "left_anti").select(*bad.columns)
    aside = f"{folder}/aside/{entry.source}/{entry.table}/{entry.batch:012d}-{uuid.uuid4().hex[:8]}"
    bad.filter("position is not null").unionByName(unplaced).drop("__h").write.parquet(aside)
    n, n_unplaced = spark.read.parquet(aside).agg(F.count(F.lit(1)), F.count(F.when(F.col("position").isNull(), 1))).first()
    return replace(entry, aside=aside if n else None, n_aside=n, n_changes=entry.n_changes + n_unplaced)


def run_feeds(spark: SparkSession, feeds: list[Feed], folder: str, most: int | None = None, batches: int | None = None, buckets: int = 64) -> DataFrame:
    """REPORT: each feed's batches until it has no more changes, or `batches` of them. A feed that fails is a row of the report, and the others go on; a later run goes on from the ledger."""
    rows = []
    for feed in feeds:
        done = 0
        while batches is None or done < batches:
            try:
                e = apply_batch(feed, folder, most, buckets)
            except Exception as error:  # one feed's failure is a row of the report
                rows.append((feed.source, feed.table, None, "failed", 0, 0, 0, 0, None, str(error)[:500]))
                break
            if e is None:
                break
            rows.append((e.source, e.table, e.batch, "success", e.n_changes, e.n_put, e.n_deleted, e.n_aside, e.position, None))
            done += 1
    return spark.createDataFrame(rows, REPORT)


def position_now(feed: Feed) -> str | None:
    """Up to where the source has told its changes by now."""
    newest = feed_changes(feed).agg(F.max("seq").alias("seq"))
    return newest.select(F.when(F.col("seq").isNotNull(), F.to_json(F.struct("seq"), TIMES))).first()[0]


def sync_feeds(spark: SparkSession, tables: dict[str, tuple[Feed, DataFrame]], folder: str, most: int | None = None, buckets: int = 64) -> DataFrame:
    """REPORT of bringing tables up to date: one that the ledger lacks is loaded whole, the others take their changes.

    tables: by name, the feed and all rows of the source. A load's position is measured
    before its rows are read, so that a change in between is applied again, not lost.
    """
    rows, known = [], []
    for name, (feed, whole) in sorted(tables.items()):
        try:
            if Ledger(spark, folder).newest(feed.source, feed.table) is not None:
                known.append(feed)
                continue
            e = load(feed, whole, folder, buckets, position_now(feed))
            rows.append((e.source, e.table, e.batch, "success", 0, e.n_put, 0, 0, e.position, None))
        except Exception as error:  # one table's failure is a row of the report
            rows.append((feed.source, name, None, "failed", 0, 0, 0, 0, None, str(error)[:500]))
    return spark.createDataFrame(rows, REPORT).union(run_feeds(spark, known, folder, most, buckets=buckets))


def vacuum(spark: SparkSession, folder: str, source: str, name: str, keep: int = 2) -> list[str]:
    """Deletes the bucket folders that none of the newest `keep` batches reads, and what stopped batches left; the deleted ones."""
    used = {f for e in Ledger(spark, folder).entries(source, name)[-keep:] for f in e.folders.values()}
    at, gone = _data(folder, source, name), []
    for made in listed(spark, at):
        inside = [f"{at}/{made}/{b}" for b in listed(spark, f"{at}/{made}") if b.startswith("__bucket=")]
        free = [f"{at}/{made}"] if not set(inside) & used else [f for f in inside if f not in used]
        for f in free:
            remove(spark, f)
        gone += free
    return gone


FED_SQL = f"""WITH e AS (SELECT *, {OP_SQL} AS op FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS by_time, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS by_id FROM e)
SELECT 'poll' AS source, user_id, event_id, value FROM n WHERE by_time = 1
UNION ALL SELECT 'log', user_id, event_id, value FROM n WHERE by_time = 1 AND op <> 'DELETE'
UNION ALL SELECT unnest(['trigger', 'stream']), user_id, event_id, value FROM n WHERE by_id = 1 AND op <> 'DELETE'"""


def event_feeds(events: DataFrame) -> list[Feed]:
    """The events as each kind of source tells its changes."""
    op, number = operation(F.col("event_type")), F.col("event_id")
    wide = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    own = ("user_id", "event_id", "value")
    code = F.when(op == "DELETE", 1).when(op == "INSERT", 2).otherwise(4)
    log = events.select(wide(F.unix_micros(F.col("ts").cast("timestamp"))).alias("__$start_lsn"), wide(number).alias("__$seqval"), code.alias("__$operation"), *own)
    trigger = events.select(number.alias("id"), F.lit("dbo").alias("schema_name"), F.lit("t").alias("table_name"), op.alias("operation"), F.to_json(F.array(F.struct(*own))).alias("row_data"), F.col("ts").alias("changed_at"))
    name = F.when(op == "DELETE", "delete").when(op == "INSERT", "insert").otherwise("replace")
    event = F.struct(F.struct(F.lpad(number.cast("string"), 19, "0").alias("_data")).alias("_id"), name.alias("operationType"), F.struct(F.lit("t").alias("coll")).alias("ns"), F.struct(F.col("user_id").cast("string").alias("_id")).alias("documentKey"), F.when(op != "DELETE", F.struct(*own)).alias("fullDocument"))
    fields = "user_id long, event_id long, value double"
    return [
        Feed("poll", "t", events.select(*own, "ts"), ("user_id",), tie="event_id"), Feed("log", "t", log, ("user_id",)),
        Feed("trigger", "t", trigger, ("user_id",), fields), Feed("stream", "t", events.select(F.to_json(event).alias("event")), ("user_id",), fields),
    ]


@query(FED_SQL)
def cdc_resumed_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a polled table, a log, a trigger log and a change stream, each applied in three runs that go on from the ledger."""
    folder, events = shared_path(spark, "feeds"), table(spark, sf_dir, "events")
    feeds, most = event_feeds(events), -(-events.count() // 3)
    for n in range(3):
        report = run_feeds(spark, feeds, folder, most if n < 2 else None, 1, buckets=8)
        if failed := report.filter("status != 'success'").collect():
            raise RuntimeError(str(failed))
    out = None
    for f in feeds:
        one = keyed_table(spark, folder, f.source, f.table).select(F.lit(f.source).alias("source"), "user_id", "event_id", "value")
        out = one if out is None else out.unionByName(one)
    out = cut(out)
    remove(spark, folder)
    return out


@query(f"""SELECT op, count(*) AS n_changes, sum(CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_aside, problem FROM (SELECT event_id, {OP_SQL} AS op,
CASE WHEN event_id % 9 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'the payload can''t be read' ELSE 'no key' END END AS problem FROM events) GROUP BY 1, 4""")
def cdc_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trigger log with broken payloads and rows without a key: the good changes are applied, the others set aside with the reason, and the ledger's counts agree."""
    folder, events = shared_path(spark, "feeds"), table(spark, sf_dir, "events")
    feed = event_feeds(events)[2]
    broken = F.when(F.col("id") % 9 != 0, F.col("row_data")).when(F.col("id") % 2 == 0, F.lit("{broken")).otherwise(F.regexp_replace("row_data", '"user_id":[0-9]+', '"user_id":null'))
    feed = replace(feed, rows=feed.rows.withColumn("row_data", broken))
    report = run_feeds(spark, [feed], folder, -(-events.count() // 2), buckets=4).collect()
    aside = set_aside(spark, folder, feed.source, feed.table).select(F.get_json_object("position", "$.seq").cast("long").alias("event_id"), "problem")
    told_of = events.select("event_id", operation(F.col("event_type")).alias("op")).join(aside, "event_id", "left")
    out = cut(told_of.groupBy("op", "problem").agg(F.count(F.lit(1)).alias("n_changes"), F.count("problem").alias("n_aside")))
    if sum(r.n_aside for r in report) != aside.count() or sum(r.n_changes for r in report) != events.count():
        raise RuntimeError("the ledger's counts differ from what was set aside")
    remove(spark, folder)
    return out
