import hashlib
import random

import pytest

from tidewright.llm import decontaminate as de
from tidewright.llm.queries import op7_decontamination

from .test_licenses import words


def brute(text, items):
    ws, hit, found = words(text), set(), set()
    for item, body in items:
        iw = words(body)
        n = min(13, len(iw))
        if not n:
            continue
        wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
        for p in range(len(ws) - n + 1):
            if tuple(ws[p : p + n]) in wins:
                hit.update(range(p, p + n))
                found.add(str(item))
    return len(ws), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(ws)


def test_query_against_brute_force(spark, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        n, h, f, c = brute(r.text, items)
        want[r.doc_id] = (n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), c)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in op7_decontamination(spark, sf_dir).collect()} == want
    assert any(x[4] for x in want.values())


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_defined_cases(spark, rough, empty, block_bytes):
    r = random.Random(5)
    long = [x.text for x in rough.collect() if x.text and len(x.text) > 1000][0].split()
    items = [(10, " ".join(long[100:130])), (9, None), (8, "!!"), (7, "one"), (6, "Two WORDS"), (5, " ".join(long[110:118])), (5, "x y z"), (4, " ".join(long[100:130]))]
    items += [(100 + i, " ".join(r.choices(long[:40], k=20))) for i in range(5)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = rough.union(spark.createDataFrame([(900, " ".join(long[95:140]), None, None, 1, None, None, None, 1, None), (901, "is one two words", None, None, 1, None, None, None, 1, None)], rough.schema))
    got = de.contamination(docs, bench, block_bytes=block_bytes).collect()
    want = sorted(((x.doc_id, *brute(x.text, items)) for x in docs.collect()), key=str)
    assert sorted(((x.doc_id, x.n_words, x.n_hit, x.items, x.contaminated) for x in got), key=str) == want
    clean = de.keep_clean(docs, bench, block_bytes=block_bytes)
    assert clean.columns == docs.columns and {x.doc_id for x in clean.collect()} == {x[0] for x in want} - {x[0] for x in want if x[4]}
    assert de.contamination(empty, bench).count() == 0
    assert de.contamination(docs, bench.limit(0)).filter("not contaminated").count() == docs.count()
