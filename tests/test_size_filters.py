"""What finds a changed row is worked out once."""

from pyspark.sql import functions as F

from tidewright.operators import changes


def test_filters_are_worked_out_once(spark):
    """the changes are read as they were worked out, however many sets of columns their filters name."""
    worked = spark.sparkContext.accumulator(0)

    @F.udf("map<string,string>")
    def told(k):
        worked.add(1)
        return {"id": str(k)} if k % 2 else {"other": str(k)}

    target = spark.range(10).selectExpr("id", "id AS other", "0 AS n")
    made = spark.range(10).select(F.lit("UPDATE").alias("op"), told("id").alias("filter"), F.expr("named_struct('id', id, 'other', id, 'n', 1)").alias("data"), F.col("id").alias("seq"))
    got = sorted(map(tuple, changes.apply_by_filter(target, made, ["seq"]).collect()))
    assert got == [(i, i, 1) for i in range(10)] and worked.value == 10


def test_known_names_come_in_their_order(spark):
    m = lambda **kv: F.create_map(*[F.lit(x) for k, v in kv.items() for x in (k, v)]).cast("map<string,string>")
    images = [(m(CustomerID="1", a="2", ID="3"), {"id": "3"}), (m(a="1", ProductId="2"), {"productid": "2"}), (m(A="1", b="2", c="3"), {"a": "1", "b": "2"}), (m(Z="9"), {"z": "9"}), (F.create_map().cast("map<string,string>"), {}), (m(ID="x", Id="y"), {"id": "x"})]
    none = F.lit(None).cast("map<string,string>")
    assert [r for r in spark.range(1).select(*[changes.row_filter(none, i).alias(f"c{n}") for n, (i, _) in enumerate(images)]).first()] == [w for _, w in images]
