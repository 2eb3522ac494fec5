import random
from itertools import combinations

import corpus_pipeline
from tidewright.llm import simhash_dedup as nc


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def groups(rows, threshold=0.8):
    """The smallest id of each row's group, over all pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
            root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return [least.get(find(n)) for n in range(len(rows))]


def check(docs, **how):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = sorted(zip((i for i, _ in rows), groups(rows), strict=True), key=str)
    assert sorted(map(tuple, nc.similar_groups(docs, **how).collect()), key=str) == want
    return {g for _, g in want}


def test_against_brute_force(spark, sf_dir, rough):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = check(docs)
    assert {r.doc_id for r in corpus_pipeline.distinct(spark, docs, sf_dir).collect()} == kept
    check(rough)


def test_small_edits_and_buckets_of_many(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(4):
        base = r.choices(words, k=120)
        for _ in range(25):
            text = list(base)
            text[r.randrange(120)] = "edited"
            rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert check(docs) == {0, 25, 50, 75}
    assert check(docs, few=2) == {0, 25, 50, 75}
    assert {x.doc_id for x in corpus_pipeline.distinct(spark, docs, "").collect()} == {0, 25, 50, 75}


def test_short_texts_lose_no_link(spark):
    """A word more or less at an end of a short text, which one fingerprint alone often tells apart; some bases share phrases."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for n in range(60):
        base = r.choices(words, k=r.randrange(1, 28)) if n % 3 or not n else rows[-1][1].split()[: r.randrange(1, 24)] + ["then"]
        for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)):
            text = base[a : len(base) - b] if n % 2 else ["first"] * a + base + ["last"] * b
            rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(r.sample(rows, len(rows)), "doc_id long, text string")
    assert len(check(docs, prints=1)) == len(check(docs, prints=1, few=2)) == len(check(docs)) < len(rows)


def test_empty(empty):
    assert nc.similar_groups(empty).count() == 0 and nc.keep_one_of_each(empty).count() == 0
