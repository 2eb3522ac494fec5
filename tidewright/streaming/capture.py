"""Change capture with Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.changes import FOLD_SQL, OP_SQL, fold_events, latest, operation
from ..plans.registry import query
from ..sources.tables import WRITTEN, clear, cut, remove, shared_path, table


def _pattern(path: str) -> str:
    """The path as a pattern: a stream reads a single file only by one."""
    return f"{path[:-1]}[{path[-1]}]"


def run_available(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> dict:
    """Applies what has arrived, batch by batch, then stops; a later run with the same checkpoint goes on from there. apply must be idempotent by batch id. Returns counters."""

    def once(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()  # apply may read it more than once
        try:
            apply(kept, batch_id)
        finally:
            kept.unpersist()

    running = stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    return {"batches": len(running.recentProgress), "rows": sum(p["numInputRows"] for p in running.recentProgress)}


def split_changes(batch: DataFrame, payload: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Well-formed changes, and those whose payload can't be read: they go to quarantine, and the batch goes on."""
    read = batch.withColumn("data", F.from_json(payload, schema, {"mode": "PERMISSIVE"}))
    bad = F.col(payload).isNotNull() & F.try_parse_json(payload).isNull()
    return read.filter(~bad), read.filter(bad).drop("data")


class Counters(StreamingQueryListener):
    """The counts of a stream's batches, as Spark reports them: what observe() has counted under `name`, by batch id."""

    def __init__(self, name: str):
        self.name, self.batches = name, {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        got = event.progress.observedMetrics.get(self.name)
        if got is not None:
            self.batches[event.progress.batchId] = got.asDict()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def apply_guarded(stream: DataFrame, payload: str, schema: str, apply: Callable[[DataFrame, int], None], aside: str, checkpoint: str) -> dict[int, dict]:
    """Applies what a stream of changes (op, and JSON in the column payload) has, batch by batch, until all that has arrived is done; the counts by batch.

    Rows whose payload can't be read go to the folder `aside`, with the reason, and the rest
    of their batch to apply, with the column data. A repeated batch overwrites what it has set
    aside; apply must be idempotent by batch id. Counted by Spark on the way: n_changes,
    n_failed, and n_insert, n_update, n_delete of those that are applied.
    """
    spark, name = stream.sparkSession, f"changes_{uuid.uuid4().hex[:8]}"
    bad = F.col(payload).isNull() | F.try_parse_json(payload).isNull()
    marked = stream.withColumn("__problem", F.when(F.col(payload).isNull(), "no payload").when(bad, "the payload can't be read"))
    counts = [F.count_if(F.col("__problem").isNull() & (F.col("op") == op)).alias(f"n_{op.lower()}") for op in ("INSERT", "UPDATE", "DELETE")]
    observed = marked.observe(name, F.count(F.lit(1)).alias("n_changes"), F.count("__problem").alias("n_failed"), *counts)

    def both(batch: DataFrame, n: int) -> None:
        written = len(WRITTEN)
        kept = cut(batch)  # read twice, and gone when both sinks have it
        kept.filter("__problem is not null").withColumnRenamed("__problem", "problem").write.mode("overwrite").parquet(f"{aside}/batch={n}")
        apply(kept.filter("__problem is null").drop("__problem").withColumn("data", F.from_json(payload, schema)), n)
        clear(spark, written)

    listener = Counters(name)
    spark.streams.addListener(listener)
    try:
        observed.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    return listener.batches


def latest_by_stream(spark: SparkSession, path: str, files_a_batch: int = 8) -> DataFrame:
    """The last change of each key of a changelog of Parquet files, through a stream. Every batch leaves its own folded folder, named by batch id: a repeated batch overwrites it."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(_pattern(path))
    out = shared_path(spark, "changes")

    def fold(batch: DataFrame, batch_id: int) -> None:
        changes = batch.select("user_id", "ts", "event_id", "value", operation(F.col("event_type")).alias("op"))
        latest(changes, ["user_id"], ["ts", "event_id"]).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_available(stream, fold, shared_path(spark, "offsets"))
    folded = spark.read.parquet(out).drop("batch")
    return latest(folded, ["user_id"], ["ts", "event_id"])


@query(f"""WITH e AS (SELECT *, {OP_SQL} AS op, CASE WHEN event_id % 7 = 0 THEN 'no payload' WHEN event_id % 5 = 0 THEN 'the payload can''t be read' END AS problem FROM events)
SELECT 'aside' AS what, problem AS of, count(*) AS n FROM e WHERE problem IS NOT NULL GROUP BY 2 UNION ALL SELECT 'applied', op, count(*) FROM e WHERE problem IS NULL GROUP BY 2
UNION ALL SELECT 'counted', 'n_' || lower(op), count(*) FROM e WHERE problem IS NULL GROUP BY 2 UNION ALL SELECT 'counted', 'n_changes', count(*) FROM e UNION ALL SELECT 'counted', 'n_failed', count(problem) FROM e""")
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of changes with planted broken payloads in several batches: what is set aside, what is applied, and what Spark counted on the way."""
    folder, number = shared_path(spark, "guarded"), F.col("event_id")
    payload = F.when(number % 7 == 0, F.lit(None)).when(number % 5 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("user_id", "value")))
    rows = table(spark, sf_dir, "events").select("event_id", operation(F.col("event_type")).alias("op"), payload.alias("payload"))
    rows.repartition(3).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(_pattern(f"{folder}/in"))

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/applied/batch={n}")

    counts = apply_guarded(stream, "payload", "user_id long, value double", keep, f"{folder}/aside", f"{folder}/offsets")
    rows = [("counted", name, sum(c[name] for c in counts.values())) for name in next(iter(counts.values()), {})]
    summed = spark.createDataFrame(rows, "what string, of string, n long").filter("n > 0 or of in ('n_changes', 'n_failed')")
    by = lambda what, of: spark.read.parquet(f"{folder}/{what}").groupBy(F.col(of).alias("of")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "of", "n")
    out = cut(by("aside", "problem").unionByName(by("applied", "op")).unionByName(summed))
    remove(spark, folder)
    return out


@query(FOLD_SQL)
def stream_cdc_available_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as cdc_fold_latest, by a stream over the changelog."""
    found = latest_by_stream(spark, f"{sf_dir}/events.parquet")
    return found.filter("op != 'DELETE'").select("user_id", "event_id", "ts", "value")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_dedupe_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day, each once even if a batch repeats it: duplicates are dropped within the watermark."""
    path = f"{sf_dir}/events.parquet"
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(_pattern(path)).select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    twice = stream.unionAll(stream)
    counted = twice.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"]).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    name = f"days_{uuid.uuid4().hex}"
    out = shared_path(spark, name)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    running = counted.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", shared_path(spark, "offsets")).trigger(availableNow=True).start()
    running.awaitTermination()
    # a window's last update is its count
    rows = spark.read.parquet(out).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "batch")
    return rows.groupBy("day", "event_type").agg(F.max_by("n", "batch").alias("n"))


__all__ = ["Counters", "apply_guarded", "fold_events", "latest_by_stream", "run_available", "split_changes", "stream_cdc_available_now", "stream_quarantine", "stream_dedupe_window"]
