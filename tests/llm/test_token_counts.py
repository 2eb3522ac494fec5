import os
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import token_counts as tc
from tidewright.llm.queries import VOCABULARY, op1_token_counts

assert os.path.exists(VOCABULARY), "these tests need the vocabulary file; none is skipped without it"
ALPHABET = "ab é 1'\n\tst  ,."


@pytest.fixture(scope="module")
def counter(spark):
    return tc.Counter(tc.read_ranks(spark, VOCABULARY), tc.BYTE_BPE_PATTERN)


@pytest.fixture(scope="module")
def encoding(spark):
    """The tokenizer itself, with its own pattern."""
    return tiktoken.Encoding("plain", pat_str=tc.BYTE_BPE_PATTERN, mergeable_ranks=tc.read_ranks(spark, VOCABULARY), special_tokens={})


@settings(max_examples=500, deadline=None)
@given(st.text(ALPHABET, max_size=200), st.lists(st.tuples(st.integers(-5, 210), st.integers(-5, 210), st.text(ALPHABET, max_size=40)), max_size=8))
def test_edits_equal_a_full_recount(counter, encoding, text, edits):
    tc.LEAF = 2  # many leaves
    try:
        recount(counter, encoding, text, edits)
    finally:
        tc.LEAF = 16


def recount(counter, encoding, text, edits):
    tree = tc.PretokenTree.of(text, counter)
    for start, stop, put in edits:
        n = len(text)
        a = min(max(start, 0), n)
        b = min(max(stop, a), n)
        text = text[:a] + put + text[b:]
        tree.edit(start, stop, put)
        pieces = counter.split(text)
        assert tree.text == text and tree.total == (len(text), len(encoding.encode_ordinary(text)), len(pieces))
        # every leaf ends at a cut
        ends, at = {0}, 0
        for p in pieces:
            at += len(p)
            ends.add(at)
        assert set(tree.leaves[0].cumsum().tolist()) <= ends
        assert (tree.nodes[:, 1] == tree.leaves.sum(axis=1)).all()


def test_only_the_touched_region_is_encoded_again(counter, encoding):
    text = " ".join(random.Random(1).choices(["alpha", "beta", "gamma", "delta,"], k=50_000))
    tree = tc.PretokenTree.of(text, counter)
    for _ in range(20):
        at = random.Random(len(text)).randrange(len(text))
        assert tree.edit(at, at + 10, "changed") < 6 * tc.LEAF
        text = text[:at] + "changed" + text[at + 10 :]
    assert tree.total[1] == len(encoding.encode_ordinary(text))
    tree.edit(100, len(text) - 100, "")
    assert tree.total[1] == len(encoding.encode_ordinary(text[:100] + text[-100:]))


def test_long_runs(spark, counter):
    """One pre-token as long as the text: the tokenizer's own pattern overflows its stack there."""
    runs = [x * 2_000_000 for x in (" ", "a", "!", "\n", "7")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(runs)], "doc_id long, text string")
    edits = spark.createDataFrame([(i, 1, 1_000_000, 1_000_000, "x") for i in range(5)], "doc_id long, seq int, start int, stop int, put string")
    got = {r.doc_id: r for r in tc.count_with_edits(tc.attach_edits(docs, edits), VOCABULARY).collect()}
    for i, t in enumerate(runs):
        per = len(counter.encoding.encode_ordinary(t[:131_072])) / 131_072
        assert abs(got[i].n_tokens - per * 2_000_000) <= 1 and got[i].edited_chars == 2_000_001


def test_trees_are_kept_and_edited_in_batches(spark, rough, encoding, tmp_path):
    """A batch names a few documents; the others' trees pass as they are, and a later batch goes on from there."""
    texts = {r.doc_id: r.text or "" for r in rough.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    tc.build_trees(docs, VOCABULARY).write.parquet(f"{tmp_path}/0")
    for n, batch in enumerate([[(10, 1, 3, 9, "Hello, world"), (10, 2, 0, 1, None)], [(10, 1, 5, 5, " again "), (5, 1, 1000, 2000, "!")]]):
        edits = spark.createDataFrame(batch, "doc_id long, seq int, start int, stop int, put string")
        for i, _, a, b, put in batch:
            texts[i] = texts[i][:a] + (put or "") + texts[i][b:]
        tc.apply_edits(spark.read.parquet(f"{tmp_path}/{n}"), edits, VOCABULARY).drop("reencoded").write.parquet(f"{tmp_path}/{n + 1}")
    rows = spark.read.parquet(f"{tmp_path}/2").select("doc_id", "text", tc.total("tokens").alias("n")).collect()
    assert {r.doc_id: r.text for r in rows} == texts
    assert all(r.n == len(encoding.encode_ordinary(r.text)) for r in rows)


def plain(encoding, text):
    return len(encoding.encode_ordinary(text))


def test_query_against_full_encoding(spark, sf_dir, encoding):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op1_token_counts(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        t = docs[r.doc_id]
        n = len(t)
        assert r.n_tokens == plain(encoding, t)
        t = t[: n // 3] + " was revised and " + t[min(n, n // 3 + 12) :]
        t = t[: n // 2] + t[min(len(t), n // 2 + 40) :]
        at = min(len(t), n + 5)
        t = t[:at] + " The end." + t[at:]
        assert (r.edited_tokens, r.edited_chars) == (plain(encoding, t), len(t))


def test_defined_cases(spark, rough, empty, encoding):
    edits = spark.createDataFrame([(0, 1, 0, 0, "put"), (4, 2, 0, 3, None), (4, 1, 3, 3, " more"), (3, 1, -4, 99, "")], "doc_id long, seq int, start int, stop int, put string")
    got = {r.doc_id: r for r in tc.count_with_edits(tc.attach_edits(rough, edits), VOCABULARY).collect()}
    assert got[0].n_tokens == 0 and got[0].edited_tokens == plain(encoding, "put")
    assert got[4].edited_tokens == plain(encoding, " more words") and got[3].edited_tokens == 0 and got[1].n_tokens == 0
    assert tc.count_with_edits(tc.attach_edits(empty, edits), VOCABULARY).count() == 0
    assert tc.count_with_edits(tc.attach_edits(rough, edits), VOCABULARY).count() == rough.count()
    clashing = rough.withColumnsRenamed({"row": "e", "id": "edits", "t": "chars"})
    assert tc.count_with_edits(tc.attach_edits(clashing, edits), VOCABULARY).count() == rough.count()
