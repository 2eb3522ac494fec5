"""What the corpus operators share: word splitting and numbering; tables and the shared folder come from sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import WRITTEN, clear, cut, remove, shared_path, table

__all__ = ["WORD_BYTES", "WRITTEN", "alnum_words", "clear", "cut", "file_bytes", "hex64", "remove", "rows_before", "shared_path", "space_words", "table", "unused", "utf8"]

#: Bytes of UTF-8 text: A-Z become a-z; a-z, 0-9 and whatever is outside ASCII stay; the rest parts words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(WORD_BYTES).split()


def space_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased."""
    return text.lower().split()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with more underscores before it where df has a column of that name, in any case of letters."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        out.append(name)
    return out


def utf8(column: str | Column) -> Column:
    """The text as bytes; null counts as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("binary"), F.lit(b""))


def hex64(column: str | Column) -> Column:
    """A long as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def file_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file that its publisher keeps fixed in size, such as a vocabulary: a path with a scheme is read by Spark, another one from the driver's disk."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as file:
        return file.read()


def rows_before(counts: DataFrame, of: str) -> DataFrame:
    """(of, __bucket, __before): the rows of the same `of` in smaller buckets. counts: (of, __bucket, n), written out.

    Summed in two levels: a window holds a thousand buckets, or the thousands of buckets of one `of`.
    """
    group = F.floor(F.col("__bucket") / 1000)
    inside = Window.partitionBy(of, "__group").orderBy("__bucket")
    small = counts.withColumn("__group", group).withColumn("__inside", F.sum("n").over(inside) - F.col("n"))
    large = counts.groupBy(of, group.alias("__group")).agg(F.sum("n").alias("n"))
    large = large.select(of, "__group", (F.sum("n").over(Window.partitionBy(of).orderBy("__group")) - F.col("n")).alias("__outside"))
    return small.join(large, [of, "__group"]).select(of, "__bucket", (F.col("__inside") + F.col("__outside")).alias("__before"))
