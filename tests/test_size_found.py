"""Keys and references where sketches leave much to count."""

from pyspark.sql import functions as F

from tidewright.operators import discovery


def test_repeats_spare_the_exact_count(spark, monkeypatch):
    """a set that is nearly unique is given up by a part of its values; one that only a few rows repeat is still counted whole."""
    counted, real = [], discovery.key_candidate

    def seen(df, keys):
        counted.append(tuple(keys))
        return real(df, keys)

    monkeypatch.setattr(discovery, "key_candidate", seen)
    df = spark.range(0, 20_000, 1, 4).select("id", F.when(F.col("id") < 19_000, F.col("id")).otherwise(F.col("id") - 1000).alias("near"), F.when(F.col("id") < 19_999, F.col("id")).otherwise(0).alias("once"))
    assert discovery.candidate_keys(df, 1) == [("id",)]
    assert ("near",) not in counted and ("id",) in counted


def test_references_send_no_list_of_columns(spark, monkeypatch):
    """the columns of a value are met as bits, more than one number has; families are kept apart."""
    plans, cut = [], discovery.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(discovery, "cut", seen)
    wide = spark.range(30).selectExpr("id AS k", "CAST(id AS STRING) AS s", *[f"id % {2 + i} AS c{i}" for i in range(70)], "CASE WHEN id > 3 THEN 'x' END AS t")
    got = {tuple(r) for r in discovery.inclusions({"w": wide}).collect()}
    assert got == {("w", f"c{i}", "w", r) for i in range(70) for r in ("k", *[f"c{j}" for j in range(28, 70)]) if r != f"c{i}"} | {("w", "k", "w", f"c{i}") for i in range(28, 70)}
    assert len(plans) == 1 and "collect_set" not in plans[0]
