import random
from itertools import combinations

import pytest
import xxhash

from tidewright.llm import simhash_dedup as sd
from tidewright.llm.queries import op3_simhash_dedup


def brute(text):
    words = [w for w in bytes(text or "", "utf-8").lower().replace(b"\x0b", b" ").split() if w]
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(ids, fps, radius=2):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(set(fps), 2):
        if (a ^ b).bit_count() <= radius:
            root[find(a)] = find(b)
    least = {}
    for i, f in zip(ids, fps, strict=True):
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [least.get(find(f)) for f in fps]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_difference(radius):
    masks = sd.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    r = random.Random(0)
    for _ in range(3000):
        diff = sum(1 << b for b in r.sample(range(64), r.randrange(radius + 1)))
        assert any(not diff & m for m in masks)
    assert all(30 <= m.bit_count() <= 44 for m in masks)


@pytest.mark.parametrize("radius", [1, 2])
@pytest.mark.parametrize("few", [2, 6])
def test_links_connect_what_all_pairs_connect(spark, radius, few):
    r = random.Random(radius)
    fps = set()
    for _ in range(40):
        f = r.getrandbits(64)
        for _ in range(r.randrange(1, 30)):
            fps.add(f)
            f ^= sum(1 << b for b in r.sample(range(64), r.randrange(1, 5)))
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = sd.covering_links(df, radius, few)
    rows = links.collect()
    assert all(0 < ((x.a ^ x.b) % (1 << 64)).bit_count() <= radius for x in rows)
    roots = {x.node % (1 << 64): x.root % (1 << 64) for x in sd.connected_components(links).collect()}
    want = groups(range(len(fps)), fps, radius)
    got = [roots.get(f, f) for f in fps]
    same = {}
    for g, w in zip(got, want, strict=True):
        assert same.setdefault(g, w) == w
    assert len(set(got)) == len(set(want))


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i + 1, i) for i in range(100, 300)] + [(1000 + i, 999) for i in range(500)]
    got = {r.node: r.root for r in sd.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 301)) and all(got[1000 + i] == 999 for i in range(500))


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    fps = [brute(d.text) for d in docs]
    want = {d.doc_id: (f"{f:016x}", g) for d, f, g in zip(docs, fps, groups([d.doc_id for d in docs], fps), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op3_simhash_dedup(spark, sf_dir).collect()} == want


def test_defined_cases(rough, empty):
    rows = rough.collect()
    got = sd.near_duplicates(rough).collect()
    fps = [brute(r.text) for r in rows]
    want = sorted(((r.doc_id, f"{f:016x}", g) for r, f, g in zip(rows, fps, groups([r.doc_id for r in rows], fps), strict=True)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want
    kept = sd.keep_one_of_each(rough, threshold=None)
    assert kept.columns == rough.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {g for _, _, g in want} | {None}
    assert sd.near_duplicates(empty).count() == 0 and sd.keep_one_of_each(empty).count() == 0


@pytest.mark.parametrize("threshold", [0.8, None])
def test_one_row_of_each_group_stays(spark, threshold):
    """Rows are told apart by id and text: of rows that share an id, only copies go; a repeated row stays once; a null id comes last."""
    a, b, c = (" ".join(f"{x}{n}" for n in range(30)) for x in "abc")
    rows = [(3, b), (5, b), (5, a), (5, a), (7, a), (None, c), (None, b), (None, c), (9, None), (9, "")]
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = sorted(map(tuple, sd.keep_one_of_each(docs, threshold=threshold).collect()), key=str)
        assert len(got) == 4 and got[:2] == [(3, b), (5, a)] and got[3] == (None, c) and got[2] in [(9, None), (9, "")]
