"""Tasks that write an index stay small where its buckets are large."""

import os
import uuid

from pyspark.sql import functions as F

from tidewright.operators.search import TextIndex, search_phrase, stem, stemmed
from tidewright.sources.tables import table


def test_a_large_bucket_has_several_files(spark, tmp_path):
    """F1 to F3: a bucket is written by as many tasks as its size asks for."""
    words = F.concat_ws(" ", *[F.concat(F.lit("w"), F.translate(F.hex(F.xxhash64("id", F.lit(i))), "0123456789", "ghijklmnop")) for i in range(20)])
    docs = spark.range(0, 4000, 1, 4).select("id", words.alias("body"))
    was = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    try:
        index = TextIndex(spark, str(tmp_path / "i"), 1)
        index.add(docs, "id", "body")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", was)
    written = spark.read.parquet(f"{tmp_path}/i/postings")
    assert len(written.inputFiles()) == 4 and written.count() == 80_000


def shuffled(spark, run):
    """Bytes that the jobs of run() write for shuffles."""
    context, group = spark.sparkContext, uuid.uuid4().hex
    context.setJobGroup(group, group)
    try:
        run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    context._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)


def test_an_index_shuffles_little_more_than_its_texts(spark, sf_dir, tmp_path):
    """what the tasks that make an index hand on is near the size of the texts, not a row for each word, form and stem."""
    sent = shuffled(spark, lambda: TextIndex(spark, str(tmp_path / "i"), 8).add(table(spark, sf_dir, "documents"), "doc_id", "text"))
    assert 0 < sent < 3 * os.path.getsize(f"{sf_dir}/documents.parquet")


def test_a_phrase_shuffles_little_more_than_its_texts(spark, sf_dir):
    """nor does the whole query of a phrase, from the texts to its rows."""
    sent = shuffled(spark, lambda: search_phrase(spark, sf_dir).collect())
    assert 0 < sent < 3 * os.path.getsize(f"{sf_dir}/documents.parquet")


def test_a_task_stems_as_a_column_does(spark):
    words = ["s", "is", "its", "bus", "pies", "ties", "licenses", "licensed", "licensing", "running", "ed", "red", "bed", "sing", "agreed", "tree", "the", "use", "a", "yes", "glass", "sked", "rhythmed"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", stem(F.col("w"))).collect()
    assert {w: s for w, s in got} == {w: stemmed(w) for w in words}
