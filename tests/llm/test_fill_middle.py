import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.oracle import connect, same
from tidewright.llm import fill_middle as fm
from tidewright.llm.queries import oracle_sql, op12_fill_middle

STARTS = {"char": r"(?s).", "word": r"[A-Za-z0-9\u0080-\U0010ffff]+", "token": r"[A-Za-z0-9\u0080-\U0010ffff]+|[^A-Za-z0-9\u0080-\U0010ffff\s]|[\x00-\x08\x0e-\x1f]", "line": r"\n"}


def parts(text, i, unit, seed=1):
    """Cuts by regular expression and slicing."""
    h = hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    draws = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    at = [m.start() for m in re.finditer(STARTS[unit], text)]
    a, b = sorted(d % (len(at) + 1) for d in draws[:2])
    cut = [*at, len(text)]
    return text[: cut[a]], text[cut[a] : cut[b]], text[cut[b] :], draws


def expected(i, text, unit="char"):
    text = text or ""
    prefix, middle, suffix, h = parts(text, "" if i is None else i, unit)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (i, len(text), "plain", None, None, text)
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (i, len(text), form, len(prefix), len(middle), out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=400), st.integers(0, 400))
def test_ranks_equal_counts(symbols, at):
    held, at = np.array(symbols, np.uint8), min(at, len(symbols))
    matrix = fm.WaveletMatrix(held)
    for c in range(6):
        assert matrix.rank(c, np.array([0, at, len(symbols)])).tolist() == [0, symbols[:at].count(c), symbols.count(c)]
    for of in ((1,), (3, 4), (1, 2, 3, 4, 5)):
        k = sum(s in of for s in symbols[:at])
        place = matrix.select(of, np.array([0]), np.array([len(symbols)]), np.array([k]))[0]
        assert place >= at and not any(s in of for s in symbols[at:place]) and (place == len(symbols) or symbols[place] in of)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab Z9é漢😀\n\t.,-_\r"), max_size=50), min_size=1, max_size=6), st.sampled_from(sorted(fm.UNITS)), st.lists(st.integers(0, 2**32 - 1), min_size=12, max_size=12))
def test_cut_places(texts, unit, draws):
    raw = [t.encode() for t in texts]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    held = np.array(draws, np.int64).reshape(2, 6)[:, : len(texts)]
    found = fm.cut_places(data, ends, held, unit).T.tolist()
    for i, t in enumerate(texts):
        at = [m.start() for m in re.finditer(STARTS[unit], t)]
        cut = [([*at, len(t)])[k] for k in sorted(int(d) % (len(at) + 1) for d in held[:, i])]
        assert found[i] == [len(at), len(t), *[len(t[:c].encode()) for c in cut], *cut]


@pytest.mark.parametrize("unit", sorted(fm.UNITS))
def test_texts_against_slicing(rough, empty, spark, unit):
    more = spark.createDataFrame([(900, "has <P> in it"), (901, "<S"), (902, "M>😀<"), (903, "\n\n"), (904, "a" * 100_000)], "doc_id long, text string")
    docs = rough.select("doc_id", "text", "row", "id", "t").unionByName(more, allowMissingColumns=True).withColumnsRenamed({"row": "form", "id": "h1", "t": "c"})
    made = fm.fill_middle(docs, unit=unit)
    assert sorted(map(tuple, made.collect()), key=str) == sorted((expected(r.doc_id, r.text, unit) for r in docs.collect()), key=str)
    back = made.select("doc_id", fm.restored("output", "form").alias("t")).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
    assert fm.fill_middle(empty, unit=unit).count() == 0


def test_shares_and_slices(spark):
    r = random.Random(1)
    docs = spark.createDataFrame([(i, "".join(r.choices("ab é\n", k=r.randrange(1, 40)))) for i in range(5000)], "doc_id long, text string")
    whole = sorted(map(tuple, fm.fill_middle(docs).collect()))
    shares = {f: sum(w[2] == f for w in whole) / len(whole) for f in ("plain", "psm", "spm")}
    assert abs(shares["plain"] - 0.1) < 0.02 and abs(shares["spm"] - 0.18) < 0.02
    assert fm.fill_middle(docs, plain_percent=0, spm_percent=100).filter("form != 'spm'").count() == 0
    with pytest.raises(ValueError):
        fm.fill_middle(docs, unit="page")
    fm.SLICE = 64  # many slices a batch
    try:
        assert sorted(map(tuple, fm.fill_middle(docs.withColumn("more", F.lit(1))).collect())) == whole
    finally:
        fm.SLICE = 1 << 22


def test_query_against_sql(spark, sf_dir):
    same(op12_fill_middle(spark, sf_dir), connect(sf_dir), oracle_sql()["op12_fill_middle"])
