import math
import time
from collections import Counter
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import mixing as mx
from tidewright.llm.queries import op2_mixing


WEIGHTS = st.dictionaries(st.text("abcdefgh", min_size=1, max_size=3), st.floats(0.001, 100), min_size=1, max_size=40)


def windows(order, weights):
    """Every source's blocks run inside their windows, and its share is never a block off: by exact fractions of the weights."""
    parts = {s: Fraction(w) for s, w in weights.items()}
    total, had = sum(parts.values()), Counter()
    share = {s: p / total for s, p in parts.items()}
    for t, s in enumerate(order, 1):
        had[s] += 1
        assert (had[s] - 1) / share[s] < t and t - 1 < had[s] / share[s] + Fraction(1, 1000)
        if t % 17 == 0 or t < 50:
            assert all(abs(had[x] - t * share[x]) < 1 + Fraction(1, 1000) for x in share)


@settings(max_examples=60, deadline=None)
@given(WEIGHTS)
def test_no_source_is_a_block_off_its_share(weights):
    order = mx.schedule(dict.fromkeys(weights, 200), weights)
    first = next(t for t in range(len(order)) if Counter(order[: t + 1])[order[t]] == 200)
    windows(order[: first + 1], weights)


def test_shares_hold_over_many_slots_and_sources():
    one = {"big": 1 / 3} | {f"s{i}": (2 / 3) / 19 for i in range(19)}
    order = mx.schedule({s: 40_000 if s == "big" else 3_000 for s in one}, one)
    t = 50_000
    assert abs(order[:t].count("big") - t / 3) < 1.001
    many = {"big": 1 / 3} | {f"s{i}": (2 / 3) / 999 for i in range(999)}
    order = mx.schedule({s: 30_000 if s == "big" else 60 for s in many}, many)
    windows(order[:20_000], many)


def test_ten_thousand_sources_take_linear_time():
    began = time.monotonic()
    blocks = {f"s{i}": 1 + i % 20 for i in range(10_000)}
    order = mx.schedule(blocks, {s: n**0.5 for s, n in blocks.items()})
    assert Counter(order) == blocks and time.monotonic() - began < 20


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcde"), st.integers(1, 60), min_size=1), st.dictionaries(st.sampled_from("abcd"), st.floats(0, 5)))
def test_schedule_against_a_plain_simulation(blocks, weights):
    assert mx.schedule(blocks, weights) == simulated(blocks, weights)


def simulated(blocks, weights):
    """Every slot in turn: of the blocks whose window is open, the one that must be done first; on equal terms the heavier source, then the smaller name."""
    left, out = {s: n for s, n in blocks.items() if n}, []
    while left:
        active = {s: weights.get(s, 0) for s in left if weights.get(s, 0) > 0} or {s: float(n) for s, n in left.items()}
        most = max(active.values())
        whole = {s: max(1, round(w / most * (1 << 40))) for s, w in active.items()}
        while live := [s for s in whole if left.get(s)]:
            total, done, t = sum(whole[s] for s in live), Counter(), 0
            while all(left[s] for s in live):
                share = {s: Fraction(whole[s], total) for s in live}
                ready = [(math.ceil((done[s] + 1) / share[s]), -whole[s], s) for s in live if done[s] / share[s] // 1 <= t]
                s = min(ready)[2]
                out.append(s)
                done[s] += 1
                left[s] -= 1
                t += 1
        left = {s: n for s, n in left.items() if n}
    return out


def test_query_against_simulation(spark):
    sf = "/root/testdata/sf0.01"
    rows = op2_mixing(spark, sf).collect()
    sizes = Counter(r.source for r in spark.read.parquet(f"{sf}/documents.parquet").select("source").collect())
    assert Counter(r.source for r in rows) == sizes and len({r.doc_id for r in rows}) == len(rows)
    for found, block_rows in ((rows, 1), (mx.mix(spark.read.parquet(f"{sf}/documents.parquet"), blocks=70).collect(), -(-len(rows) // 70))):
        order = simulated({f"s{s}": -(-n // block_rows) for s, n in sizes.items()}, {f"s{s}": n**0.5 for s, n in sizes.items()})
        taken, want = Counter(), {}
        for slot, s in enumerate(order):
            want[slot] = (s, taken[s])
            taken[s] += 1
        assert {r.slot: (f"s{r.source}", r.block) for r in found} == want
        by_block = Counter((r.source, r.block) for r in found)
        assert all(n == block_rows or b == max(x for s2, x in by_block if s2 == s) for (s, b), n in by_block.items())
        assert len({(r.slot, r.nth) for r in found}) == len(rows)


def test_defined_cases(rough, empty):
    mixed = mx.in_mix_order(rough, {"s0": 3, "s1": 1}, blocks=100)
    assert mixed.columns == rough.columns and mixed.exceptAll(rough).count() == 0 and rough.exceptAll(mixed).count() == 0
    order = [r.source for r in mixed.collect()]
    assert Counter(order[:8]) == {"s0": 6, "s1": 2}
    last = [i for i, s in enumerate(order) if s in ("s0", "s1")][-1]
    assert all(s not in ("s0", "s1") for s in order[last + 1 :]) and None in order
    assert mx.mix(empty).count() == 0 and mx.in_mix_order(empty).count() == 0


def test_columns_named_like_the_schedule(spark):
    names = ["start", "first", "n", "slots", "period", "places", "before", "block", "slot", "nth"]
    docs = spark.createDataFrame([(i, "ab"[i % 2], *[i] * len(names)) for i in range(40)], "doc_id long, source string, " + ", ".join(f"{n} int" for n in names))
    got = mx.in_mix_order(docs, blocks=10)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))


def test_rows_of_one_id(spark):
    """Repeated and null ids are spread over buckets; every row gets its place."""
    docs = spark.range(0, 60_000, 1, 4).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 7 else id end as doc_id", "cast(id as string) as text", "'a' as source")
    got = mx.mix(docs, blocks=1000)
    assert got.select("slot", "nth").distinct().count() == got.count() == 60_000
    placed = mx.with_places(docs, blocks=1000)
    assert placed.select("__slot", "__nth").distinct().count() == placed.select("text").distinct().count() == 60_000
