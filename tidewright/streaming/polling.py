"""Polling servers for changed rows as a streaming source: an offset (time, key) for each table, partitions by table and range."""

from __future__ import annotations

import importlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.changes import latest
from ..plans.registry import query
from ..sources.tables import cut, remove, shared_path, table

#: Rows that a task asks for at a time.
FETCH = 10_000


class Range(InputPartition):
    """The rows of a table behind `start`, up to `end`."""

    def __init__(self, name: str, start: list | None, end: list):
        self.name, self.start, self.end = name, start, end


class Polled(DataSourceStreamReader):
    """Reads what has changed since the last trigger. Offsets are kept by the stream's checkpoint."""

    def __init__(self, options: dict[str, str]):
        self.driver = importlib.import_module(options["driver"])  # a DB-API module
        self.mark = {"qmark": "?", "format": "%s", "pyformat": "%s"}[self.driver.paramstyle]
        self.tables = json.loads(options["tables"])
        self.rows = int(options.get("rowsperpartition", "100000"))
        for t in self.tables.values():
            if not all(re.fullmatch(r"[A-Za-z_][\w.$]*", n) for n in (t["table"], t["at"], t["key"])):
                raise ValueError("names of tables and columns must be plain")

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "driver"} | {"module": self.driver.__name__}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.driver = importlib.import_module(state["module"])

    def _ask(self, name: str, what: str, start: list | None, end: list | None, tail: str = "", ordered: bool = False):
        """A cursor over the rows between two positions, the first one left out."""
        t, where, values = self.tables[name], [f"{self.tables[name]['at']} IS NOT NULL"], []
        at, key = t["at"], t["key"]
        for place, sign in ((start, ">"), (end, "<")):
            if place is not None:
                where.append(f"({at} {sign} {self.mark} OR ({at} = {self.mark} AND {key} {sign}{'=' * (sign == '<')} {self.mark}))")
                values += [place[0], place[0], place[1]]
        connection = self.driver.connect(**t["connect"])
        cursor = connection.cursor()
        cursor.execute(f"SELECT {what} FROM {t['table']} WHERE {' AND '.join(where)}" + f" ORDER BY {at}, {key}" * ordered + tail, values)
        return connection, cursor

    def _first(self, *asked, **more) -> tuple | None:
        connection, cursor = self._ask(*asked, **more)
        try:
            return cursor.fetchone()
        finally:
            connection.close()

    def initialOffset(self) -> dict:  # noqa: N802
        return dict.fromkeys(self.tables)

    def latestOffset(self) -> dict:  # noqa: N802
        """The newest position of each table. A row that comes with an older one afterwards is not seen, as with any poll by time."""
        newest = {n: self._first(n, f"{t['at']}, {t['key']}", None, None, f" ORDER BY {t['at']} DESC, {t['key']} DESC LIMIT 1") for n, t in self.tables.items()}
        return {n: None if place is None else list(place) for n, place in newest.items()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        """Ranges of about `rowsPerPartition` rows of each table that has changes."""
        out = []
        for name, last in end.items():
            place = start.get(name)
            if last is None or last == place:
                continue
            t = self.tables[name]
            while True:
                # the position of the last row of the next range
                cut_at = self._first(name, f"{t['at']}, {t['key']}", place, last, f" LIMIT 1 OFFSET {self.rows - 1}", ordered=True)
                stop = last if cut_at is None else list(cut_at)
                out.append(Range(name, place, stop))
                if stop == last:
                    break
                place = stop
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        connection, cursor = self._ask(partition.name, "*", partition.start, partition.end, ordered=True)
        try:
            names = [c[0] for c in cursor.description]
            while rows := cursor.fetchmany(FETCH):
                data = [json.dumps(dict(zip(names, r, strict=True)), default=str) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([partition.name] * len(rows)), pa.array(data)], ["table_name", "data"])
        finally:
            connection.close()

    def commit(self, end: dict) -> None:
        pass


class TablePoll(DataSource):
    """format("table_poll"): (table_name, data), rows as JSON.

    Options: driver, the name of a DB-API module; tables, JSON by name: connect (keywords of
    its connect()), table, at, key; rowsPerPartition. Servers are asked for what lies
    between two positions only, so a repeated batch has the same rows.
    """

    @classmethod
    def name(cls) -> str:
        return "table_poll"

    def schema(self) -> str:
        return "table_name string, data string"

    def streamReader(self, schema) -> Polled:  # noqa: N802
        return Polled({k.lower(): v for k, v in self.options.items()})


def poll(spark: SparkSession, driver: str, tables: dict[str, dict], rows_per_partition: int = 100_000) -> DataFrame:
    """The stream of the tables' changed rows."""
    spark.dataSource.register(TablePoll)
    return spark.readStream.format("table_poll").options(driver=driver, tables=json.dumps(tables), rowsPerPartition=str(rows_per_partition)).load()


def _into_servers(rows: DataFrame, folder: str, servers: int) -> None:
    """Adds rows to SQLite files in a folder, by a hash of the user: they stand for servers here. A file is made anew beside the old one and put in its place, so a repeated task adds nothing twice."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import shutil
        import sqlite3

        path, made = f"{folder}/{TaskContext.get().partitionId()}.db", f"{folder}/{uuid.uuid4().hex}.part"
        if os.path.exists(path):
            shutil.copy(path, made)
        with sqlite3.connect(made) as db:
            db.execute("CREATE TABLE IF NOT EXISTS events (event_id INTEGER PRIMARY KEY, ts TEXT, user_id INTEGER, value REAL)")
            for b in batches:
                db.executemany("INSERT OR REPLACE INTO events VALUES (?, ?, ?, ?)", zip(*[c.to_pylist() for c in b.columns], strict=True))
        db.close()
        os.replace(made, path)
        yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    rows.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "user_id", "value").repartition(servers, "user_id").mapInArrow(add, "path string").collect()  # one row for each server


@query("SELECT user_id, event_id, ts, value FROM (SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def stream_polled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, polled from four servers in three triggers, as the servers get the events by their time; each trigger is a run of its own that goes on from the offsets."""
    folder, events = shared_path(spark, "polled").removeprefix("file:"), table(spark, sf_dir, "events")
    os.makedirs(f"{folder}/servers", exist_ok=True)
    first, second = events.select(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [0.33, 0.67]).alias("p")).first().p
    time = F.unix_micros(F.col("ts").cast("timestamp"))
    tables = {f"server{n}": {"connect": {"database": f"{folder}/servers/{n}.db"}, "table": "events", "at": "ts", "key": "event_id"} for n in range(4)}

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    for low, high in ((None, first), (first, second), (second, None)):
        _into_servers(events.filter((F.lit(low is None) | (time > F.lit(low))) & (F.lit(high is None) | (time <= F.lit(high)))), f"{folder}/servers", 4)
        stream = poll(spark, "sqlite3", tables)
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/out").select(F.from_json("data", "user_id long, event_id long, ts timestamp_ntz, value double", {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}).alias("d")).select("d.*")
    out = cut(latest(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "ts", "value"))
    remove(spark, folder)
    return out
