import corpus_pipeline
from tidewright.llm import mixing


def test_weights_reach_the_result(spark, sf_dir, monkeypatch):
    """A shard's slots follow the mixture, so other weights give run() another result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = []
    for weights in (None, {"src0": 50.0, "src1": 1.0, "src2": 1.0}):
        monkeypatch.setattr(corpus_pipeline, "WEIGHTS", weights)
        rows = corpus_pipeline.run(spark, sf_dir).collect()
        kept = docs.join(spark.createDataFrame([(r.doc_id,) for r in rows], "doc_id long"), "doc_id", "left_semi")
        place = {r.doc_id: (r["__slot"], r["__nth"]) for r in mixing.with_places(kept, weights).collect()}
        for shard in {r.shard for r in rows}:
            ids = [r.doc_id for r in sorted(rows, key=lambda r: r.slot) if r.shard == shard]
            assert ids == sorted(ids, key=place.get)
            assert sorted(r.slot for r in rows if r.shard == shard) == list(range(len(ids)))
        found.append({r.doc_id: (r.shard, r.slot) for r in rows})
    assert found[0].keys() == found[1].keys() and found[0] != found[1]
    assert {i: s for i, (s, _) in found[0].items()} == {i: s for i, (s, _) in found[1].items()}
