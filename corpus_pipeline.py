"""A training corpus from `documents`: five stages, each over all that the one before kept.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and
read again as the next stage's docs. The first four return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import decontaminate, mixing, sharding, simhash_dedup, toxicity
from tidewright.llm.common import WRITTEN, clear, cut, remove, shared_path, table, unused

#: Target weights of the sources in the mixture; None: the square roots of their sizes.
WEIGHTS: dict[str | None, float] | None = None


#: Rows of text that Python gets at a time: what a worker holds goes with them.
BATCH = 1000


def _bounded(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model rejects. It learns from the table `labels`, held-out rows apart."""
    _bounded(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=~toxicity.held_out())
    return toxicity.keep_civil(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near copies: similarity 0.8 or more of five-word shingles."""
    _bounded(spark)
    return simhash_dedup.keep_one_of_each(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the benchmark contaminates."""
    _bounded(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts all documents in the order of the mixture."""
    return mixing.in_mix_order(docs, WEIGHTS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their size, checksum, shard and place there: a shard's slots follow the mixture, found again from the same rows. These four take the place of columns that have their names."""
    row, tie = unused(docs, "__row", "__tie")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(tie, mixing.content(docs)))
    assigned = sharding.assign_shards(rows, keep=("source", row, tie))
    placed = sharding.slots_in_order(mixing.with_places(assigned, WEIGHTS, tie=tie))
    own = ("size", "text_crc32", "shard", "slot")
    return rows.drop(tie, *own).join(placed.select(row, *own), row).drop(row)


STAGES = [("toxicity", civil), ("near duplicates", distinct), ("benchmark", unseen), ("mixture", mixed), ("shards", sharded)]

#: SQL can express neither the trained classifier nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. What a stage keeps is written to the shared checkpoint folder, and deleted when the next stage is written."""
    folder, written = shared_path(spark, "pipeline"), len(WRITTEN)
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        clear(spark, written)
        if n:
            remove(spark, f"{folder}/{n - 1}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return docs
