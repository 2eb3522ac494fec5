import glob

from pyspark.sql import functions as F

import corpus_pipeline
from tidewright.llm import common, decontaminate, simhash_dedup, toxicity


def test_stages(spark, sf_dir, tmp_path):
    docs = common.table(spark, sf_dir, "documents")
    labels, bench = common.table(spark, sf_dir, "labels"), common.table(spark, sf_dir, "benchmark")
    ids = {"input": {r.doc_id for r in docs.collect()}}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "toxicity":
            model = toxicity.train(before, labels, usable=~toxicity.held_out())
            assert ids[name] == {r.doc_id for r in before.collect() if model.score(set(common.alnum_words((r.text or "").encode()))) < 0.5}
        elif name == "near duplicates":
            found = simhash_dedup.similar_groups(before).collect()
            assert ids[name] == {r.component_id for r in found} < {r.doc_id for r in found}
        elif name == "benchmark":
            assert ids[name] == {r.doc_id for r in decontaminate.contamination(before, bench).collect() if not r.contaminated} < {r.doc_id for r in before.collect()}
        else:
            assert docs.count() == before.count() and ids[name] == {r.doc_id for r in before.collect()}
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.schema == before.schema
    assert len(corpus_pipeline.STAGES) == 5
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))
    assert whole.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "text_crc32", "shard", "slot"]


def test_intermediate_folders_go(spark, sf_dir):
    folder = spark.conf.get("spark.checkpoint.dir")
    held = lambda: {p for p in glob.glob(f"{folder}/*/*") if "rdd-" not in p}
    before = held()
    out = corpus_pipeline.run(spark, sf_dir)
    new = held() - before
    assert len(new) == 1 and out.count() > 0 and [p.rsplit("/", 1)[1] for p in glob.glob(f"{new.pop()}/*")] == ["4"]


def test_stages_take_an_empty_table(spark, empty, sf_dir):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_stages_take_rough_rows(spark, rough, sf_dir, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and columns named like the operators' own, through every stage."""
    rough.write.parquet(f"{tmp_path}/documents")
    docs = spark.read.parquet(f"{tmp_path}/documents")
    bench = common.table(spark, sf_dir, "benchmark")
    passage = bench.orderBy("item_id").first().text
    planted = docs.limit(1).withColumn("doc_id", F.lit(9001).cast("long")).withColumn("text", F.lit(passage))
    planted.write.parquet(f"{tmp_path}/planted")
    docs = docs.union(spark.read.parquet(f"{tmp_path}/planted").select(*docs.columns))
    every = docs.select("doc_id", "text").collect()
    stages = dict(corpus_pipeline.STAGES)

    civil = stages["toxicity"](spark, docs, sf_dir)
    assert civil.schema.names == docs.columns and civil.count() <= len(every)

    distinct = stages["near duplicates"](spark, docs, sf_dir)
    kept = distinct.select("doc_id", "text").collect()
    found = simhash_dedup.similar_groups(docs).collect()
    assert distinct.schema.names == docs.columns
    assert {r.doc_id for r in kept if r.doc_id is not None} == {r.component_id for r in found if r.component_id is not None}
    assert sum(r.doc_id is None for r in kept) == sum(r.doc_id is None for r in every) == 1
    assert len({(r.doc_id, r.text) for r in kept}) == len(kept)

    unseen = stages["benchmark"](spark, docs, sf_dir)
    left = unseen.select("doc_id").collect()
    assert unseen.schema.names == docs.columns and 9001 not in {r.doc_id for r in left} and len(left) == len(every) - 1

    mixed = stages["mixture"](spark, docs, sf_dir)
    assert mixed.schema.names == docs.columns and sorted(map(str, mixed.collect())) == sorted(map(str, docs.collect()))

    placed = stages["shards"](spark, docs, sf_dir).collect()
    assert len(placed) == len(every)
    loads = [sum(r.shard == s for r in placed) for s in range(16)]
    assert max(loads) - min(loads) <= 1
    assert all(sorted(r.slot for r in placed if r.shard == s) == list(range(loads[s])) for s in range(16))


#: Names that the stages give columns of their own.
OWN = ("__score", "__id", "__raw", "__n", "__text", "__bad", "__doc", "__source", "__tie", "__row", "__src", "__h", "__bucket", "__before", "__i", "__block", "__slot", "__nth", "__at", "__keep0", "node", "raw", "pick", "cell", "nth", "h", "lo", "hi", "at")


def test_columns_named_like_the_stages_own(spark, rough, sf_dir, tmp_path):
    """Each stage hands on the values of columns that are named like its own."""
    docs = rough.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in OWN])
    docs.write.parquet(f"{tmp_path}/documents")
    docs = spark.read.parquet(f"{tmp_path}/documents")
    held = set(map(tuple, docs.collect()))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        got = [tuple(r) for r in out.select(*docs.columns).collect()]
        assert got and set(got) <= held, name
        assert out.columns[: len(docs.columns)] == docs.columns, name
