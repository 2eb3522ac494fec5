import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.operators import documents, relational

VALUES = ["1", "-0", "999999999999999999", "9223372036854775807", "9223372036854775808", "-9223372036854775808", "1" * 38, "1" * 39, "1.5", "1e3", "true", "null", '"1"', '"true"', "[]", "[1,{}]", '"\\u00e9"']
BROKEN = ["", " ", "[]", "1", '"x"', "null", "{", '{"a": 1} x', '{"a": NaN}', '{"a": 1, "a": 2}', "{'a': 1}", '{"a": 01}', '{"a": Infinity}', "{} {}", None]


def test_types_are_those_of_variants(spark):
    """The walk names types as the parsed value does, and skips what Spark can't parse."""
    texts = [f'{{"v": {v}}}' for v in VALUES] + BROKEN
    df = spark.createDataFrame(list(enumerate(texts)), "i int, d string")
    parsed = df.select("i", F.try_parse_json("d").alias("p")).select("i", F.schema_of_variant("p").startswith("OBJECT").alias("ok"), documents.json_type(F.try_variant_get("p", "$.v", "variant")).alias("k"), F.try_variant_get("p", "$", "map<string,variant>").isNotNull().alias("m"))
    for r in parsed.collect():
        got = dict(documents.typed_leaves(texts[r.i] or ""))
        want = {("v",): r.k or "VOID"} if r.i < len(VALUES) else {}
        assert got == (want if r.ok else {}), texts[r.i]
    assert documents.typed_leaves('{"v": -2.0}') == [(("v",), "DOUBLE")]  # a whole value, but no whole number


tree = st.recursive(st.one_of(st.integers(-9, 9), st.booleans(), st.none(), st.text(max_size=3), st.just([1])), lambda inner: st.dictionaries(st.text("ab'.\"]", max_size=3), inner, max_size=3), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("xyz", min_size=1, max_size=2), tree, max_size=3))
def test_leaves_by_recursion(document):
    def walk(value, path=()):
        if isinstance(value, dict):
            for k, v in value.items():
                yield from walk(v, (*path, k))
        else:
            yield path

    assert sorted(p for p, _ in documents.typed_leaves(json.dumps(document))) == sorted(walk(document))


def test_odd_names_and_depth(spark):
    deep = {"end": 1}
    for n in range(60):
        deep = {f"l{n}": deep}
    odd = {"it's": {'say "x"': 1, "a.b": {"c]": "t"}}, "both'\"": 2.5, "": {"e": True}, "[0]": [1], "$": None}
    df = spark.createDataFrame([(json.dumps(x),) for x in (deep, odd, {}, {"": {}})], "d string")
    fields = [(r.path, r.inferred) for r in documents.infer_fields(df, "d").collect()]
    assert len(fields) == 7 and max(len(p) for p, _ in fields) == 61
    rows = documents.document_rows(df, "d", fields)
    values = sorted(str(v) for r in rows.collect() for v in r if v is not None)
    assert values == sorted(["1", "1", "t", "2.5", "True", "[1]"])


def test_many_paths_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(documents, "HELD", 5)
    df = spark.createDataFrame([(json.dumps({f"k{i % 40}": i, "same": "x"}),) for i in range(400)], "d string")
    got = {r.field: (r.inferred, r.n_documents) for r in documents.infer_fields(df, "d").collect()}
    assert got == {f"k{i}": ("BIGINT", 10) for i in range(40)} | {"same": ("STRING", 400)}


def test_as_of_against_every_period_tried(spark):
    import datetime as dt
    import random

    r, day = random.Random(5), lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
    periods, facts = [], []
    for k in [*range(12), None]:
        at = sorted(r.sample(range(3000), r.randrange(0, 12)))
        ends = [r.choice([b, b - 1, a - 1, a + 3]) if b else r.choice([None, a + 900]) for a, b in zip(at, [*at[1:], None])]
        periods += [(k, day(a), None if e is None else day(min(e, b - 1) if b else e), a) for a, e, b in zip(at, ends, [*at[1:], None])]
        facts += [(k, day(r.choice([*at, r.randrange(-50, 3200)])), n) for n in range(25)]
    facts += [(3, None, 99), (77, day(5), 98)]
    f = spark.createDataFrame(facts, "k int, at timestamp_ntz, n int")
    p = spark.createDataFrame(periods, "k int, s timestamp_ntz, e timestamp_ntz, v int")
    want = sorted((k, n, v) for k, at, n in facts for q, s, e, v in periods if k is not None and k == q and at is not None and s <= at and (e is None or at <= e))
    for days in (30, 365, 100_000):
        assert sorted((x.k, x.n, x.v) for x in relational.as_of(f, p, ["k"], "at", "s", "e", days).filter("k is not null").collect()) == want
