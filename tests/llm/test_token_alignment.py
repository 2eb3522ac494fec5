import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewright.llm import token_alignment as ta
from tidewright.llm.queries import BYTE_BPE, PIECE_BPE, op13_token_alignment


class Plain:
    """Both tokenizers as their libraries offer them, and every pair of tokens tried."""

    def __init__(self):
        self.a = Tokenizer.from_file(BYTE_BPE)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
        keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.back = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in keep)}

    def piece(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def tokens(self, text):
        if not text:
            return [], []
        held = f" {text}".encode()
        sides = []
        for ids, of in ((self.a.encode(f" {text}", add_special_tokens=False).ids, lambda i: bytes(self.back[c] for c in self.a.id_to_token(i))), (self.b.encode(text), self.piece)):
            at, side = 0, []
            for i in ids:
                side.append((i, at, at + len(of(i))))
                at += len(of(i))
            if b"".join(map(of, ids)) != held:
                return [], []
            sides.append(side)
        return tuple(sides)

    def align(self, text):
        a, b = self.tokens(text)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = []
        for low, high in zip([0, *cuts], cuts):
            groups.append("|".join(",".join(str(t[0]) for t in side if low <= t[1] < high) for side in (a, b)))
        return len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""

    def rows(self, docs):
        made = [(i, self.align(t)) for i, t in docs]
        held = Counter(p for _, m in made for p in set(m[3]))
        best = defaultdict(int)
        for (a, _), n in held.items():
            best[a] = max(best[a], n)
        return sorted(((i, a, b, g, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), sha) for i, (a, b, g, links, sha) in made), key=str)


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.fixture(scope="module")
def aligner():
    return ta.Aligner(*(open(p, "rb").read() for p in (BYTE_BPE, PIECE_BPE)))


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def got(df, id_col="doc_id"):
    return sorted(((r[id_col], *[r[n] for n in NAMES]) for r in df.collect()), key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("ab the\n\t  <|endoftext|>é ▁ 12'sñ　​漢字"), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=5))
def test_slices_equal_every_pair_tried(plain, aligner, texts):
    counted, digests, starts, pairs, times = aligner.align(texts)
    for i, t in enumerate(texts):
        a, b, groups, links, sha = plain.align(t)
        assert [int(c[i]) for c in counted] == [a, b, groups, len(links)] and digests[i] == sha
        own = Counter(x * len(aligner.b.bytes) + y for x, y in links)
        assert dict(zip(pairs[starts[i] : starts[i + 1]].tolist(), times[starts[i] : starts[i + 1]].tolist())) == dict(own)


def test_query_against_brute_force(spark, sf_dir, plain):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(op13_token_alignment(spark, sf_dir)) == plain.rows(docs)


def test_defined_cases(spark, rough, empty, plain):
    docs = [(r.doc_id, r.text) for r in rough.collect()]
    short = [(i, t) for i, t in docs if t is None or len(t) < 1000]
    df = rough.filter("text is null or length(text) < 1000")
    want = plain.rows(short)
    assert got(ta.alignment(df, BYTE_BPE, PIECE_BPE)) == want
    # blocks of a few pairs, and columns that have the names of the result's
    clashing = df.withColumnsRenamed({"row": "pairs", "id": "n_a", "t": "times", "fp": "row"})
    assert got(ta.alignment(clashing, BYTE_BPE, PIECE_BPE, block=40)) == want
    assert ta.alignment(empty, BYTE_BPE, PIECE_BPE).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, ""), (None, "▁")], "doc_id long, text string")
    assert got(ta.alignment(nothing, BYTE_BPE, PIECE_BPE)) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, None)]


def test_long_texts(spark, aligner):
    """Texts of one pre-token, and one of many slices' length."""
    r = random.Random(2)
    texts = ["a" * 200_000, " " * 100_000, "\n" * 100_000, " ".join(r.choices(["token", "tide", "été", "x1"], k=400_000))]
    counted, digests, _, _, _ = aligner.align(texts)
    assert all(c > 0 for c in counted[0]) and len({*digests}) == 4
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.doc_id, r.n_a, r.n_b, r.groups_sha256) for r in ta.alignment(rows, BYTE_BPE, PIECE_BPE).collect()) == [(i, int(counted[0][i]), int(counted[1][i]), digests[i]) for i in range(4)]
