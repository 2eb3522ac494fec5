import hashlib
import math
import random
import re
from collections import Counter

import xxhash

from tidewright.llm import fingerprints as fp
from tidewright.llm.queries import op8_fingerprints


def edited(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, u = t or "", u or ""
        half = len(t) // 2
        out[i] = (t, t[: len(t) - half] + u[:half], u)
    return out


def hexed(text):
    return "".join(f"{x % (1 << 64):016x}" for x in fp.simhash(text.encode()))


def alike(a, b):
    return 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want, prints = edited(rows), {i: hexed(t or "") for i, t in rows}
    got = op8_fingerprints(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        t, e, u = want[r.doc_id]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert r.fingerprint == prints[r.doc_id] and r.edited_fingerprint == hexed(e)
        assert r.near_edited == alike(hexed(t), hexed(e)) and r.near_next == alike(hexed(t), hexed(u))
        near = sum((int(r.fingerprint, 16) ^ int(p, 16)).bit_count() <= 3 for p in prints.values())
        assert r.n_near == (near if r.doc_id % 100 == 0 else None)
    assert sum(r.near_edited > r.near_next for r in got) > 0.9 * len(got)


def test_block_tables_find_everything_within_the_radius(spark):
    r = random.Random(2)
    rows = []
    for _ in range(30):
        x = r.getrandbits(128)
        rows += [x ^ sum(1 << b for b in r.sample(range(128), n)) for n in (0, 1, 2, 3, 4, 5)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(x >> 64), signed(x % (1 << 64))) for x in rows], "hi long, lo long")
    got = {(x.hi % (1 << 64)) << 64 | x.lo % (1 << 64): x.n_near for x in fp.within(df, df, 3).collect()}
    assert got == {x: sum((x ^ y).bit_count() <= 3 for y in rows) for x in rows}


def test_defined_cases(spark, rough, empty):
    got = fp.edit_fingerprints(rough)
    assert got.count() == rough.count()
    rows = [(r.doc_id, r.text) for r in rough.dropDuplicates(["doc_id"]).collect()]
    unique = spark.createDataFrame([r for r in rows if r[0] is not None], "doc_id long, text string")
    want = edited([r for r in rows if r[0] is not None])
    assert {r.id: r.edited_sha256 for r in fp.edit_fingerprints(unique).collect()} == {i: hashlib.sha256(e.encode()).hexdigest() for i, (_, e, _) in want.items()}
    assert fp.edit_fingerprints(empty).count() == 0
    one = fp.edit_fingerprints(unique.filter("doc_id = 4")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"Two wTwo ").hexdigest()
    assert fp.simhash(b" ,\n") == (0, 0)


def test_fingerprint_bit_by_bit():
    """The votes written out, one bit at a time."""
    for text in ("One two, three; one two", "é1 b b b b a", "x", "the tide turns and the tide falls " * 9):
        words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        count = Counter(f"{a} {b}" for a, b in zip(["", *words], words, strict=False))
        bits = ""
        for k in range(128):
            vote = sum((1 + math.log(n)) * (1 if xxhash.xxh3_128_intdigest(term.encode(), 42) >> (127 - k) & 1 else -1) for term, n in count.items())
            bits += "1" if vote > 1e-5 else "0"
        assert f"{int(bits, 2):032x}" == hexed(text)
