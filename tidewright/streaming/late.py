"""Changes that come late or twice: the newest position of each key is state, older arrivals are refused."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.changes import FOLD_SQL, latest, operation
from ..plans.registry import query
from ..sources.tables import cut, listed, remove, shared_path, table
from .capture import _pattern

#: Rows are kept as JSON; times to the microsecond.
TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State that is kept on disk beside memory, as keyed state asks for, for the streams started inside."""
    was = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STORE, was)


def _newest(order: list[str]) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Lets the newest change of a key pass if it is newer than what has passed before, for all keys of a bucket at once.

    The state of a bucket is the position of each of its keys that passed last. A key's position
    ends when the watermark has passed that time: whatever is older is late by then, and
    never gets here. A timer sees to buckets that get no more rows.
    """

    def last(rows: pd.DataFrame) -> pd.DataFrame:
        n = rows.groupby("__key")["__n"].sum()
        top = rows.sort_values(order).drop_duplicates("__key", keep="last")
        return top.assign(__n=top["__key"].map(n))

    def fold(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(dict(zip(["__key", *order], state.get, strict=True))) if state.exists else None
        if not state.hasTimedOut:
            # a part is folded before the next one is read, so a hot key costs no memory
            best = last(pd.concat([last(part.assign(__n=1)) for part in parts], ignore_index=True)).assign(__new=True)
            both = best if held is None else pd.concat([held.assign(__new=False), best], ignore_index=True)
            # of equal positions the held one stays
            held = both.sort_values([*order, "__new"], ascending=[True] * len(order) + [False]).drop_duplicates("__key", keep="last")
            passed = best["__key"].isin(held.loc[held["__new"], "__key"])
            yield pd.DataFrame({"row": best["__row"], "passed": passed, "n_refused": best["__n"] - passed})
        now = max(state.getCurrentWatermarkMs(), 0)
        held = held[(held[order[0]] // 1000 + 1 > now) | (held[order[0]] < 0)]  # no timer is there for times before 1970
        if held.empty:
            if state.exists:
                state.remove()
            return
        state.update(tuple(held[c].tolist() for c in ("__key", *order)))
        ends = held[order[0]].where(held[order[0]] >= 0).min()
        if ends == ends:
            state.setTimeoutTimestamp(int(ends) // 1000 + 1)

    return fold


def newest_changes(stream: DataFrame, key: list[str], seq: list[str], delay: str, buckets: int = 512) -> DataFrame:
    """The columns of stream, passed and n_refused: for each key of a batch its newest change, and whether it is newer than all that passed before; n_refused: changes that are not.

    seq: what orders changes, a time first (no nulls). A change may come `delay` after later
    ones; beyond that Spark drops it as late, and counts it in the stream's progress.
    buckets: groups of keys whose state is kept together, since a call of Python for each
    key costs more than the key; a checkpoint keeps to its number.
    """
    order, kinds = [], []
    for s in seq:
        c, kind = F.col(f"`{s}`"), stream.schema[s].dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            # pandas has times without a zone, where an hour may come twice
            c, kind = F.unix_micros(c if isinstance(kind, T.TimestampType) else F.to_timestamp_ltz(F.concat(c.cast("string"), F.lit("Z")))), T.LongType()
        order.append(c.alias(f"__{len(order)}"))
        kinds.append(kind)
    names = [f"__{i}" for i in range(len(order))]
    position = T.StructType([T.StructField("__key", T.ArrayType(T.StringType())), *[T.StructField(n, T.ArrayType(k)) for n, k in zip(names, kinds, strict=True)]])
    # a row goes through Python as text: pandas would make doubles of whole numbers beside nulls
    keys = [F.col(f"`{k}`") for k in key]
    timed = stream.withWatermark(seq[0], delay).select(
        F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("__bucket"), F.to_json(F.struct(*keys), TIMES).alias("__key"), *order, F.to_json(F.struct("*"), TIMES).alias("__row"), F.col(f"`{seq[0]}`").alias("__at")
    )
    made = timed.groupBy("__bucket").applyInPandasWithState(_newest(names), "row string, passed boolean, n_refused long", position, "update", GroupStateTimeout.EventTimeTimeout)
    return made.select(F.from_json("row", stream.schema, TIMES).alias("row"), "passed", "n_refused").select("row.*", "passed", "n_refused")


def keep_newest(spark: SparkSession, stream: DataFrame, key: list[str], seq: list[str], delay: str, out: str, checkpoint: str) -> dict:
    """Writes what passes by batch under `out`, a repeated batch in place of itself; runs until all that has arrived is done. Counts: batches, passed, refused."""
    counts = {"batches": 0, "passed": 0, "refused": 0}

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
        passed, refused = spark.read.schema(batch.schema).parquet(f"{out}/batch={n}").agg(F.count_if("passed"), F.coalesce(F.sum("n_refused"), F.lit(0))).first()
        counts.update(batches=counts["batches"] + 1, passed=counts["passed"] + passed, refused=counts["refused"] + refused)

    with rocksdb(spark):
        made = newest_changes(stream, key, seq, delay)
        made.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return counts


@query(FOLD_SQL)
def stream_late_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as cdc_fold_latest, by a stream that gets every event twice and in no order, in several batches."""
    folder = shared_path(spark, "late")
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value", operation(F.col("event_type")).alias("op"))
    twice = events.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    # the batch goes with a hash of event and copy; each has files for all tasks
    dealt = twice.repartition(4 * spark.sparkContext.defaultParallelism, F.xxhash64("event_id", "n")).drop("n")
    dealt.write.parquet(f"{folder}/in")
    files = sum(n.startswith("part-") for n in listed(spark, f"{folder}/in"))
    stream = spark.readStream.schema(dealt.schema).option("maxFilesPerTrigger", -(-files // 4)).parquet(_pattern(f"{folder}/in"))
    # batches come in no order of time, so all of history may come late
    keep_newest(spark, stream, ["user_id"], ["ts", "event_id"], "36500 days", f"{folder}/out", f"{folder}/offsets")
    passed = spark.read.parquet(f"{folder}/out").filter("passed")
    out = cut(latest(passed.select("user_id", "ts", "event_id", "value", "op"), ["user_id"], ["ts", "event_id"]).filter("op != 'DELETE'").select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value"))
    remove(spark, folder)
    return out
