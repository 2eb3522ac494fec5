import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.llm import line_dedup as ld
from tidewright.llm.queries import line_dedup_sql, op6_line_dedup


def brute(texts, min_lines, min_words):
    """(kept text, longest later copy) of each; the first of equal runs stays."""
    lines = [(t or "").split("\n") for t in texts]
    gone, longest = set(), [0] * len(texts)
    places = [(d, i) for d, ls in enumerate(lines) for i in range(len(ls))]
    size = 1
    while places:
        count, first = {}, {}
        for d, i in places:
            if i + size <= len(lines[d]):
                run = tuple(lines[d][i : i + size])
                count[run] = count.get(run, 0) + 1
                if first.setdefault(run, (d, i)) != (d, i):
                    longest[d] = max(longest[d], size)
                    if size >= min_lines or sum(len(x.split()) for x in run) >= min_words:
                        gone |= {(d, i + k) for k in range(size)}
        places = [(d, i) for d, i in places if count.get(tuple(lines[d][i : i + size]), 0) > 1 and i + size <= len(lines[d])]
        size += 1
    return ["\n".join(x for i, x in enumerate(ls) if (d, i) not in gone) for d, ls in enumerate(lines)], longest


@pytest.mark.parametrize("min_lines,min_words", [(1, 5), (2, 50), (3, 4), (4, 9), (5, 50)])
def test_against_brute_force(spark, min_lines, min_words):
    block = ["a b c", "", "tide in", "é", "tide out", "one two three four five six"]
    texts = ["\n".join(block), "x\n" + "\n".join(block), None, "", "\n\n\n\n", "\n".join(block[1:4] * 4), "y\n" + "\n".join(block[2:]) + "\nz", "one two three four five six", "q"] + ["\n".join(block)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in ld.dedup_lines(docs, min_lines=min_lines, min_words=min_words).collect()}
    want, longest = brute(texts, min_lines, min_words)
    assert [got[i].kept for i in range(len(texts))] == want
    assert [got[i].longest for i in range(len(texts))] == longest
    assert all(got[i].n_lines - got[i].n_deleted == (len(w.split("\n")) if w or got[i].n_lines > got[i].n_deleted else 0) for i, w in enumerate(want))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=24).map("\n".join), min_size=2, max_size=6))
def test_lengths_of_any_copies(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.kept, r.longest) for r in ld.dedup_lines(docs).orderBy("doc_id").collect()]
    assert got == list(zip(*brute(texts, 3, 50), strict=True))


def test_long_copies_of_all_lengths(spark):
    """Repeats of 1 to 40 lines at shifted places: the length is exact, not a power of two."""
    base = [f"line {k}" for k in range(40)]
    texts = ["\n".join(base)] + ["\n".join(["own %d" % n, *base[n % 5 : n % 5 + n], "end %d" % n]) for n in range(1, 36)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.kept, r.longest) for r in ld.dedup_lines(docs).orderBy("doc_id").collect()]
    assert got == list(zip(*brute(texts, 3, 50), strict=True)) and [x for _, x in got[1:]] == list(range(1, 36))


def test_two_long_lines_count_by_their_words(spark):
    passage = " ".join(f"u{k}" for k in range(30)) + "\n" + " ".join(f"v{k}" for k in range(30))
    docs = spark.createDataFrame([(1, "a\n" + passage), (2, passage + "\nb"), (3, "u1 u2\nv1")], "doc_id long, text string")
    assert [(r.doc_id, r.kept) for r in ld.dedup_lines(docs).orderBy("doc_id").collect()] == [(1, "a\n" + passage), (2, "b"), (3, "u1 u2\nv1")]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_order_of_the_copies(spark, kind):
    """The smallest id keeps its lines whatever the reading order and other rows: repeated ids, null ids, ids that are texts."""
    ids = [5, 1, 9, 9, None, 3, None]
    run = "l\nm\nn"
    texts = [run, run, "p\nq\nr", "s\n" + run, run, "p\nq\nr\nt", "p\nq\nr"]
    cast = (lambda i: i) if kind == "long" else (lambda i: None if i is None else str(i))
    for n, parts in ((7, 1), (5, 3)):
        rows = [(cast(i), t) for i, t in zip(ids, texts, strict=True)]
        docs = spark.createDataFrame(rows[:n] if n < 7 else rows, f"doc_id {kind}, text string").repartition(parts)
        hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
        ordered = sorted(hashed, key=lambda r: (r.doc_id is None, r.doc_id or cast(0), r.h))
        want = sorted(zip([str(r.doc_id) for r in ordered], brute([r.text for r in ordered], 3, 50)[0], strict=True))
        assert sorted((str(r.doc_id), r.kept) for r in ld.dedup_lines(docs).collect()) == want


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(line_dedup_sql()).fetchall())
    got = sorted(tuple(r) for r in op6_line_dedup(spark, sf_dir).select("doc_id", "n_lines", "n_deleted", "longest", "kept_sha256").collect())
    assert got == want
    docs = con.sql("select text from documents order by doc_id").fetchall()
    kept, longest = brute([t for (t,) in docs], 3, 50)
    assert [r[3] for r in got] == longest
    assert [r[4] for r in got] == [hashlib.sha256(k.encode()).hexdigest() for k in kept]


def test_ranks_are_in_suffix_order_inside_intervals(spark):
    seqs = [[1, 2, 3, 4], [1, 2, 3, 5], [1, 2, 4], [2, 3, 4], [1, 2, 3, 4]]
    lines = spark.createDataFrame([(d, i, x, 0) for d, s in enumerate(seqs) for i, x in enumerate(s)], "row long, i int, a long, b long")
    for h, level in ld.repeated_levels(lines):
        rows = level.collect()
        key = {(r.row, r.i): tuple(seqs[r.row][r.i : r.i + h]) for r in rows}
        windows = [tuple(s[i : i + h]) for s in seqs for i in range(len(s) - h + 1)]
        assert sorted(key.values()) == sorted(w for w in windows if windows.count(w) > 1)
        by_rank = sorted(rows, key=lambda r: r.r)
        assert [key[r.row, r.i] for r in by_rank] == sorted(key.values())


def test_defined_cases(spark, rough, empty):
    rows = sorted(rough.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.h))
    want, longest = brute([r.text for r in rows], 3, 50)
    got = [(str(r.doc_id), r.kept, r.longest) for r in ld.dedup_lines(rough).collect()]
    assert sorted(got) == sorted(zip([str(r.doc_id) for r in rows], want, longest, strict=True))
    assert ld.dedup_lines(empty).count() == 0
