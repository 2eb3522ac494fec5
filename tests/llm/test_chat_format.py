import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.oracle import connect, same
from tidewright.llm import chat_format as cf
from tidewright.llm.queries import BYTE_BPE, op11_chat_format, oracle_sql

SCHEMA = "conv_id long, turn long, role string, text string"
AWKWARD = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|", "<|", "<", "\\|", "<<|im_sep|>", "|>", "", None, "\n\nlines\n", " blanks ", "é😀<|endoftext|>", "<|im_start|>user<|im_sep|>x<|im_end|>"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows, loss=("assistant",)):
    talks = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        talks.setdefault(c, []).append((role or "", text or ""))
    return sorted(((c, len(x), sha("".join(f"{r}\n{t}\n" for r, t in x)), sum(len(t) for r, t in x if r in loss), sha("".join(t for r, t in x if r in loss))) for c, x in talks.items()), key=str)


def got(df):
    return sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()), key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=0, max_size=12, unique=True), st.lists(st.tuples(st.integers(0, 60), st.integers(0, 6)), max_size=20))
def test_binary_search_equals_every_span_tried(edges, tokens):
    edges = sorted(edges)[: len(edges) // 2 * 2]
    spans = list(zip(edges[::2], edges[1::2]))
    starts, ends = np.array([s for s, _ in tokens], np.int32), np.array([s + n for s, n in tokens], np.int32)
    a, b = np.array(spans, np.int32).reshape(-1, 2).T
    want = [any(s < y and x < e for x, y in spans) for s, e in zip(starts.tolist(), ends.tolist())]
    sized = ends > starts
    assert cf.overlaps(starts, ends, a, b)[sized].tolist() == np.array(want, bool)[sized].tolist()


def test_escapes_can_be_undone(spark):
    made = spark.createDataFrame([(t,) for t in AWKWARD if t is not None], "t string").select("t", cf.escaped(F.col("t")).alias("e")).collect()
    assert all(cf.unescaped(r.e) == r.t and "<|" not in r.e for r in made) and len({r.e for r in made}) == len(made)


def test_masks_and_tokens(spark):
    rows = [(1, i, r.choice(["user", "assistant", "system", "<|im_sep|>"]), t) for r in [random.Random(4)] for i, t in enumerate(AWKWARD * 3)]
    made = cf.format_chats(spark.createDataFrame(rows, SCHEMA), BYTE_BPE).collect()
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    tokenizer.add_special_tokens([cf.OPEN, cf.SEP, cf.CLOSE])
    said = []
    for r in made:
        e = tokenizer.encode(r.formatted, add_special_tokens=False)
        assert e.ids == r.token_ids
        held = {tokenizer.token_to_id(x) for x in (cf.OPEN, cf.SEP, cf.CLOSE)}
        assert not any(m and i in held for i, m in zip(r.token_ids, r.loss))
        # every character of the rendered text is in a token's span
        assert set().union(*[range(a, b) for a, b in zip(r.starts, r.ends)]) == set(range(len(r.formatted)))
        covered = sorted(set().union(*[range(a, b) for a, b, m in zip(r.starts, r.ends, r.loss) if m]))
        said.append("".join(r.formatted[i] for i in covered))
    texts = [t or "" for _, _, role, t in rows if role == "assistant"]
    assert cf.unescaped("".join(said)) == "".join(texts)


def test_conversations_of_any_length(spark):
    """Long conversations make several rows, and meet the edges of tasks; the fold is the same."""
    r = random.Random(7)
    rows = [(c, t, r.choice(["user", "assistant"]), r.choice(AWKWARD) if r.random() < 0.2 else "word " * r.randrange(30)) for c in range(40) for t in range(r.randrange(1, 9))]
    rows += [(99, t, "assistant" if t % 2 else "user", f"turn {t} " * 9) for t in range(4000)]
    rows += [(None, 0, None, "no conversation"), (None, None, "assistant", None), (5, 900, "assistant", "x" * 600_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7).cache()
    want = expected(rows)
    formatted = cf.format_chats(df, BYTE_BPE)
    assert got(cf.read_back(formatted)) == want
    cf.SEGMENT = 500
    try:
        cut = cf.cut(cf.format_chats(df, BYTE_BPE))
        assert cut.filter("not whole").count() > 50 and got(cf.read_back(cut)) == want
        keys = [tuple(x) for x in cut.filter("whole").select("conv_id").collect()]
        assert len(keys) == len(set(keys)) and not set(keys) & {tuple(x) for x in cut.filter("not whole").select("conv_id").collect()}
    finally:
        cf.SEGMENT = 1 << 18


def test_defined_cases(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cf.read_back(cf.format_chats(none, BYTE_BPE)).count() == 0
    rows = [(1, 0, "user", "same"), (1, 0, "user", "same"), (2, 1, "assistant", "b"), (2, 0, "bot", "a")]
    clashing = spark.createDataFrame(rows, SCHEMA).withColumns({"conv": F.lit("x"), "whole": F.lit(1), "tie": F.lit(None), "formatted": F.lit("y")})
    assert got(cf.read_back(cf.format_chats(clashing, BYTE_BPE))) == expected(rows)
    assert got(cf.read_back(cf.format_chats(clashing, BYTE_BPE, loss_roles=("bot", "assistant")))) == expected(rows, ("bot", "assistant"))
    named = spark.createDataFrame([("a", 1, "user", "x")], "talk string, nth int, who string, said string")
    assert cf.read_back(cf.format_chats(named, BYTE_BPE, "talk", "nth", "who", "said"), "talk").first().n_turns == 1


def test_query_against_sql(spark, sf_dir):
    same(op11_chat_format(spark, sf_dir), connect(sf_dir), oracle_sql()["op11_chat_format"])


@pytest.mark.parametrize("size", [1, 3])
def test_a_turn_of_any_size(spark, size):
    rows = [(1, 0, "assistant", "long text " * 100_000 * size), (1, 1, "user", "ok")]
    assert got(cf.read_back(cf.format_chats(spark.createDataFrame(rows, SCHEMA), BYTE_BPE))) == expected(rows)
