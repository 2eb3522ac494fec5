"""Search, discovery and hierarchies against brute force."""

import math
import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidewright.operators import discovery, hierarchy
from tidewright.operators.search import ENDINGS, B, K1, TextIndex, stem

FORMS = {"license": "licens", "licenses": "licens", "licensed": "licens", "licensing": "licens", "release": "releas", "releases": "releas", "released": "releas", "token": "token", "tokens": "token", "libraries": "library", "library": "library", "glass": "glass", "status": "status", "this": "this", "string": "string", "being": "being", "red": "red", "runs": "run", "is": "is", "as": "as", "ties": "tie", "process": "process"}


def stemmed(w):
    for pattern, put in ENDINGS:
        w = re.sub(pattern, rf"\g<1>{put}", w)
    return w


def test_forms_of_a_word_share_a_stem(spark):
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in FORMS], "w string").select("w", stem(F.col("w")).alias("s")).collect()}
    assert {w: got[w] for w in FORMS} == {w: stemmed(w) for w in FORMS}
    assert all(got[w] == s for w, s in FORMS.items() if w not in ("ties", "red", "being")), got


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    words = ["license", "licensed", "Tokens", "token", "rain", "falls", "fell", "running", "runs", "the", "x1"]
    made = [(i, " ".join(r.choices(words, k=r.randrange(0, 40)))) for i in range(120)]
    return [*made, (200, None), (201, ""), (202, "Öl-Preis token, TOKEN; token\ntokens")]


def bm25(texts, asked):
    docs = {k: [stemmed(w) for w in re.findall("[a-z]+", (t or "").lower())] for k, t in texts}
    mean = sum(map(len, docs.values())) / len(docs)
    worth = {}
    for w, x in asked.items():
        worth[stemmed(w)] = max(x, worth.get(stemmed(w), 0))
    out = {}
    for term, weight in worth.items():
        df = sum(term in d for d in docs.values())
        for k, d in docs.items():
            if tf := d.count(term):
                out[k] = out.get(k, 0) + weight * math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(d) / mean))
    return out


def test_ranks_and_phrases(spark, texts, tmp_path):
    whole, parts = TextIndex(spark, f"{tmp_path}/whole", 4), TextIndex(spark, f"{tmp_path}/parts", 4)
    df = spark.createDataFrame(texts, "id long, body string")
    whole.add(df, "id", "body")
    for n in range(3):
        parts.add(df.filter(F.col("id") % 3 == n), "id", "body")
    parts.add(df.filter("id < 0"), "id", "body")  # an empty batch
    for asked in ({"tokens": 1.0}, {"licensing": 2.0, "run": 1.0, "running": 3.0}, {"nothing": 1.0}):
        want = bm25(texts, asked)
        for index in (whole, parts):
            got = {r.key: r.score for r in index.search(asked).collect()}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    for phrase in (["token", "rain"], ["run", "run", "the"], ["token", "token"]):
        want = Counter()
        for k, t in texts:
            ws = [stemmed(w) for w in re.findall("[a-z]+", (t or "").lower())]
            want[k] = sum(ws[i : i + len(phrase)] == [stemmed(p) for p in phrase] for i in range(len(ws)))
        for index in (whole, parts):
            assert {r.key: r.n for r in index.phrase(phrase).collect()} == {k: n for k, n in want.items() if n}


def test_a_search_reads_its_buckets_alone(spark, texts, tmp_path):
    index = TextIndex(spark, f"{tmp_path}/i", 16)
    index.add(spark.createDataFrame(texts, "id long, body string"), "id", "body")
    assert len(set(index._of(["token"]).inputFiles())) == 1


def test_keys_by_every_set_tried(spark):
    r = random.Random(4)
    rows = [(i % 7, i // 7, r.randrange(3), i if i % 5 else None, f"n{i}", 0.5 * i, r.randrange(60)) for i in range(70)]
    columns = ["a", "b", "c", "d", "e", "f", "g"]
    df = spark.createDataFrame(rows, "a int, b long, c int, d int, e string, f double, g int")
    want = []
    for size in (1, 2, 3):
        for s in combinations([c for c in columns if c != "f"], size):
            values = [tuple(row[columns.index(c)] for c in s) for row in rows]
            if len(set(values)) == len(rows) and not any(None in v for v in values) and not any(set(k) <= set(s) for k in want):
                want.append(s)
    assert sorted(discovery.candidate_keys(df, 3)) == sorted(want) and ("a", "b") in want and ("e",) in want
    assert discovery.candidate_keys(df.filter("a < 0")) == []
    assert discovery.candidate_keys(df.union(df)) == []


def test_references_by_every_pair_tried(spark):
    tables = {
        "p": spark.sql("SELECT id AS k, CAST(id * 2 AS INT) AS even, concat('n', id) AS name FROM range(20)"),
        "q": spark.sql("SELECT id AS k, CASE WHEN id % 3 > 0 THEN id % 10 END AS ref, concat('n', id % 4) AS named, CAST(NULL AS INT) AS nothing, id * 1.5D AS x FROM range(40)"),
    }
    values = {(t, c): ([x[0] for x in df.select(c).collect()], discovery.family(df.schema[c].dataType)) for t, df in tables.items() for c in df.columns if discovery.family(df.schema[c].dataType)}
    want = sorted((*a, *b) for a, (v, f) in values.items() for b, (w, g) in values.items() if a != b and f == g and {x for x in v if x is not None} and {x for x in v if x is not None} <= set(w) and len(set(w)) == len(w) and None not in w)
    assert sorted(map(tuple, discovery.inclusions(tables).collect())) == want and ("q", "named", "p", "name") in want


def test_roots_of_chains_trees_and_cycles(spark):
    r = random.Random(8)
    parent = {i: i - 1 for i in range(1, 10_000)}  # one chain
    parent |= {20_000 + i: 20_000 + r.randrange(i) for i in range(1, 300)}  # a tree
    parent |= {30_000: 30_003, 30_001: 30_000, 30_002: 30_001, 30_003: 30_002, 30_004: 30_002, 30_005: 30_004, 40_000: 40_000}  # a cycle with a branch, a node that is its own parent
    edges = spark.createDataFrame([*parent.items(), (None, 5), (50_000, None)], "c long, p long")
    want = {}
    for n in {*parent, *parent.values()}:
        at, depth, seen = n, 0, set()
        while at in parent and at not in seen:
            seen.add(at)
            at, depth = parent[at], depth + 1
        want[n] = (None, None, True) if at in parent else (at, depth, False)
    got = {x.node: (x.root, x.depth, x.cyclic) for x in hierarchy.roots(edges, "c", "p").collect()}
    assert got == want and got[9_999] == (0, 9_999, False) and got[30_005][2] and got[40_000][2]
    assert hierarchy.roots(edges.filter("c < 0"), "c", "p").count() == 0


def test_explosion_by_day(spark):
    rows = [(1, 2, 2, "2020-01-01", None), (1, 3, 1, "2020-01-01", "2020-06-30"), (2, 4, 5, "2020-01-01", None), (3, 4, 7, "2020-01-01", None), (4, 5, 1, "2021-01-01", None)]
    edges = spark.createDataFrame(rows, "assembly long, component long, quantity int, from string, to string")
    day = lambda d: [(x.node, x.level, float(x.quantity)) for x in hierarchy.bill_of_materials(edges, 1, F.lit(d)).collect()]
    assert day("2020-06-30") == [(2, 1, 2.0), (3, 1, 1.0), (4, 2, 17.0)]
    assert day("2022-01-01") == [(2, 1, 2.0), (4, 2, 10.0), (5, 3, 10.0)] and day("2019-01-01") == []
    up = [(x.origin, x.node, x.level) for x in hierarchy.bill_of_materials(edges, [4, 2], None, up=True).collect()]
    assert up == [(2, 1, 1), (4, 2, 1), (4, 3, 1), (4, 1, 2)]
    with pytest.raises(RecursionError):
        hierarchy.bill_of_materials(edges.union(edges.limit(1).selectExpr("2L", "1L", "1", "'2020-01-01'", "NULL")), 1)
