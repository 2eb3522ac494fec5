"""XML is parsed once for all its values."""

from pyspark.sql import functions as F

from tidewright.operators import documents
from tidewright.sources.tables import table


def test_values_of_odd_texts(spark, sf_dir, tmp_path, monkeypatch):
    """one parse of a text gives all its values, as they were; blanks, marks, empty and missing ones too."""
    rows = [(1, "a<b>&c", " x ", 3), (2, "", None, None), (3, None, "\u00e9\U0001f600 ]]>", -1), (4, "  ", "a\nb", 0), (5, None, None, None), (6, "null", '"', 2147483647)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    made = documents.xml_value(spark, str(tmp_path))
    assert sorted(map(tuple, made.collect())) == rows
    assert "xpath" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert documents.xml_value(spark, sf_dir).count() == table(spark, sf_dir, "part").count()
