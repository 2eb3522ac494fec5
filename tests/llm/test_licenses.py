import re

from tidewright.llm import licenses as li
from tidewright.llm.queries import op5_license_scan

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def base(text):
    ws = words(text)
    at = sorted((i, label) for phrase, label in li.BASE_PHRASES.items() for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split())
    return len(ws), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


def same(rows, found):
    want = sorted((r.doc_id, *base(r.text)) for r in rows)
    assert sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found) == want
    for r in found:
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")


def test_query_against_brute_force(spark, sf_dir):
    same(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), op5_license_scan(spark, sf_dir).collect())


def test_spans(spark):
    mit = li.NOTICES["mit"].split()
    changed = " ".join([*mit[:20], "quite", "plainly", *mit[20:30], *mit[31:]])
    texts = [
        (0, "Released under the MIT License, MIT-license; mit license"),
        (1, "GNU general public  LICENSE or general public license general public"),
        (2, "lorem " * 50 + changed + " ipsum" * 30),
        (3, " ".join(mit[:12])),
        (4, "Licensed under CC BY-NC 4"),
        (5, "the rights to use and the software, as is, to whom it may concern " * 40),
        (6, (li.NOTICES["apache"] + " x ") * 3),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = li.scan_licenses(docs).collect()
    same(docs.collect(), found)
    got = {r.doc_id: r for r in found}
    assert got[0].n_base == 3 and got[1].n_base == 2 and got[1].labels == "gpl"
    assert got[2].labels == "mit" and got[2].n_base == 0 and 0.8 < got[2].score < 1
    assert got[3].labels == "" and got[4].labels == "cc-by,cc-by-nc" and got[5].labels == ""
    assert got[6].labels == "apache" and got[6].n_base == 3


def test_defined_cases(spark, rough, empty):
    same([r for r in rough.collect() if r.doc_id is not None], [r for r in li.scan_licenses(rough).collect() if r.doc_id is not None])
    assert li.scan_licenses(empty).count() == 0
    twice = spark.createDataFrame([(1, "mit license")] * 2, "doc_id long, text string")
    assert [r.n_base for r in li.scan_licenses(twice).collect()] == [1, 1]


def test_a_template_that_repeats_a_k_gram(spark):
    """One word put in, or left out, parts the notice in two diagonals; the repeated k-gram's stray hits do not keep them apart."""
    ws = "under this license the license you may copy and change all of it here the license you may give to whom you like with no fee at all".split()
    templates = li.Templates(base={}, phrases={}, notices={"own": " ".join(ws)})
    texts = [(0, " ".join([*ws[:12], "quite", *ws[12:]])), (1, " ".join(ws[:12] + ws[13:])), (2, " ".join(ws)), (3, " ".join(ws[:9])), (4, "the license you may " * 9)]
    got = {r.doc_id: r.labels for r in li.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string"), templates=templates).collect()}
    assert got == {0: "own", 1: "own", 2: "own", 3: "", 4: ""}
