"""Rounds of a hierarchy stay on the executors."""

from pyspark.sql import functions as F

from tidewright.operators import hierarchy


def test_no_round_of_a_hierarchy_goes_through_the_driver(spark, monkeypatch):
    """the tables of the rounds are never broadcast."""
    plans, cut = [], hierarchy.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(hierarchy, "cut", seen)
    edges = spark.range(1, 200).selectExpr("id AS c", "id - 1 AS p")
    assert hierarchy.roots(edges, "c", "p").agg(F.max("depth")).first()[0] == 199
    assert len(plans) > 8 and not [p for p in plans if "Broadcast" in p]
