"""Full-text search by an inverted index: postings by term, BM25 ranks, stems of inflected forms, phrases by positions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.registry import query
from ..sources.tables import cut, listed, remove, shared_path, table

#: Endings that English words take, and what is left without them, one after the other: a plural in -ies, a plural, -ing and -ed behind a closed syllable, a last e.
ENDINGS = ((r"^(..+)ies$", "y"), (r"^(..+[^siu])s$", ""), (r"^(.*[aeiouy][^aeiouy]+)(?:ing|ed)$", ""), (r"^(...+)e$", ""))
#: Constants of BM25: how soon repeats of a term count less, how much long texts do.
K1, B = 1.2, 0.75


def stem(word: Column) -> Column:
    """What a word shares with its inflected forms."""
    for pattern, put in ENDINGS:
        word = F.regexp_replace(word, pattern, f"$1{put}")
    return word


@lru_cache(1 << 16)
def stemmed(word: str) -> str:
    """stem() of one word of letters a-z, for tasks that meet it often."""
    for pattern, put in ENDINGS:
        word = re.sub(pattern, rf"\g<1>{put}", word)
    return word


def _lines(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(key, words), words parted by blanks, as (key, size, bucket, lines): a text's part of a bucket, with a line "stem position ..." for each stem."""
    for batch in batches:
        rows, sizes, held, lines = [], [], [], []
        for row, words in enumerate(batch.column("words").to_pylist()):
            forms, terms, parts = {}, {}, {}
            for at, word in enumerate(found := (words or "").split()):
                forms.setdefault(word, []).append(at)
            for word, at in forms.items():
                terms.setdefault(stemmed(word), []).extend(at)
            for term, at in terms.items():
                parts.setdefault(crc32(term.encode()) % buckets, []).append(f"{term} {' '.join(map(str, sorted(at)))}")
            for bucket, each in parts.items():
                rows.append(row)
                sizes.append(len(found))
                held.append(bucket)
                lines.append(",".join(each))
        keys = batch.column("key").take(pa.array(rows, pa.int32()))
        yield pa.RecordBatch.from_arrays([keys, pa.array(sizes, pa.int32()), pa.array(held, pa.int32()), pa.array(lines, pa.string())], ["key", "size", "bucket", "lines"])


def postings(docs: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """(term, key, tf, positions, size, bucket): one row for each stem of each text; positions count its words from 0; size: words of the text. Null texts have none. In a task, rows are in the order of their bucket and term.

    A text's words are put together in its own row, and only its lines are shuffled, to their
    buckets: a bucket grows with the texts, a task does not; large ones are parted, small ones are one part.
    """
    words = docs.select(F.col(key).alias("key"), F.regexp_replace(F.lower(text), "[^a-z]+", " ").alias("words"))
    made = T.StructType([words.schema["key"]]).add("size", "integer").add("bucket", "integer").add("lines", "string")
    parts = words.mapInArrow(lambda batches: _lines(batches, buckets), made).hint("rebalance", F.col("bucket"))
    # a line begins with its term, and sorts as its term does; read into columns, rows would be half as large again in the sort
    each = parts.select("key", "size", "bucket", F.explode(F.split("lines", ",")).alias("line")).sortWithinPartitions("bucket", "line").withColumn("line", F.split("line", " "))
    return each.select(F.get("line", F.lit(0)).alias("term"), "key", (F.size("line") - 1).alias("tf"), F.slice("line", F.lit(2), F.size("line")).cast("array<int>").alias("positions"), "size", "bucket")


class TextIndex:
    """An index in a folder: postings by a hash of their term, and totals; each batch of texts adds files and changes none.

    Keys tell texts apart: a text is added once, under a key that is new.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.crc32(term.cast("binary")), F.lit(self.buckets)).cast("int")

    def add(self, docs: DataFrame, key: str, text: str) -> None:
        """Adds the texts. The totals are written last: a batch that stopped before is not searched; it is to be added again to a new folder of postings."""
        n = len(listed(self.spark, f"{self.folder}/totals"))
        made = f"{self.folder}/postings/batch={n}"
        postings(docs, key, text, self.buckets).write.mode("overwrite").partitionBy("bucket").parquet(made)
        words = self.spark.read.parquet(made).agg(F.sum("tf")).first()[0] if listed(self.spark, made) != ["_SUCCESS"] else 0
        self.spark.createDataFrame([(n, docs.count(), words or 0)], "batch int, docs long, words long").write.parquet(f"{self.folder}/totals/{n}")

    def _of(self, terms: list[str]) -> DataFrame:
        """The postings of some terms: their buckets are listed and read, nothing else."""
        held = {r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(self._bucket(F.col("t"))).collect()}
        batches = [b for b in range(len(listed(self.spark, f"{self.folder}/totals")))]
        have = {b: set(listed(self.spark, f"{self.folder}/postings/batch={b}")) for b in batches}
        paths = [f"{self.folder}/postings/batch={b}/bucket={x}" for b in batches for x in sorted(held) if f"bucket={x}" in have[b]]
        kind = self.spark.read.parquet(f"{self.folder}/postings").select("term", "key", "tf", "positions", "size").schema if not paths else None
        return (self.spark.read.parquet(*paths) if paths else self.spark.createDataFrame([], kind)).filter(F.col("term").isin(terms))

    def stems(self, words: list[str]) -> list[str]:
        made = self.spark.createDataFrame([(w,) for w in words], "w string").select(stem(F.lower("w")))
        return [r[0] for r in made.collect()]

    def search(self, weights: dict[str, float]) -> DataFrame:
        """(key, score): the texts with any form of any of the words, by BM25 times the word's weight. Words of one stem count once, with the largest weight."""
        worth: dict[str, float] = {}
        for s, w in zip(self.stems(list(weights)), weights.values(), strict=True):
            worth[s] = max(w, worth.get(s, 0.0))
        total = self.spark.read.parquet(f"{self.folder}/totals/*").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
        found = self._of(list(worth))
        # one row for each word asked for
        df = F.broadcast(found.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
        mean = (total.words or 1) / max(total.docs or 1, 1)
        idf = F.log(1 + (F.lit(float(total.docs or 0)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        damped = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / mean))
        weight = F.create_map(*[F.lit(x) for kv in worth.items() for x in kv])[F.col("term")]
        return found.join(df, "term").groupBy("key").agg(F.sum(weight * idf * damped).alias("score"))

    def phrase(self, words: list[str]) -> DataFrame:
        """(key, n): how often each text has the words, in any form, one after the other."""
        stems = self.stems(words)
        found = self._of(sorted(set(stems)))
        # each place of a word as the phrase's start; kept where all words agree
        back = lambda i: F.transform("positions", lambda p: p - i)
        starts = [found.filter(F.col("term") == s).select("key", back(i).alias(f"p{i}")) for i, s in enumerate(stems)]
        met = reduce(lambda a, b: a.join(b, "key"), starts)
        every = reduce(F.array_intersect, [F.col(f"p{i}") for i in range(len(stems))])
        return met.select("key", F.size(every).alias("n")).filter("n > 0")


#: The searches of the registered queries: words with their weights.
SEARCHES = {"licences": {"licensed": 5.0, "releases": 3.0, "public": 1.0}, "tokens": {"token": 1.0, "passwords": 2.0}, "none": {"zzzz": 1.0}}


def _stem_sql(word: str) -> str:
    for pattern, put in ENDINGS:
        word = f"regexp_replace({word}, '{pattern}', '\\1{put}')"
    return word


TERMS_SQL = f"""w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
t AS (SELECT doc_id, {_stem_sql('word')} AS term, count(*) AS tf FROM w GROUP BY 1, 2),
size AS (SELECT doc_id, count(*) AS size FROM w GROUP BY 1), total AS (SELECT (SELECT count(*) FROM documents) AS docs, count(*) AS words FROM w)"""
ASKED_SQL = " UNION ALL ".join(f"SELECT '{name}' AS search, {_stem_sql(repr(w))} AS term, {x} AS weight" for name, words in SEARCHES.items() for w, x in words.items())
SEARCH_SQL = f"""WITH {TERMS_SQL}, asked AS ({ASKED_SQL}), df AS (SELECT term, count(*) AS df FROM t GROUP BY 1)
SELECT search, doc_id, round(sum(weight * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * size / (words / docs)))), 6) AS score
FROM asked JOIN t USING (term) JOIN df USING (term) JOIN size USING (doc_id), total GROUP BY 1, 2"""


def _searched(index: TextIndex) -> DataFrame:
    each = [index.search(words).select(F.lit(name).alias("search"), F.col("key").alias("doc_id"), F.round("score", 6).alias("score")) for name, words in SEARCHES.items()]
    return cut(reduce(DataFrame.unionByName, each))


@query(SEARCH_SQL)
def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several ranked searches of one index; the texts are read once, for the index."""
    index = TextIndex(spark, shared_path(spark, "index"), buckets=8)
    index.add(table(spark, sf_dir, "documents"), "doc_id", "text")
    out = _searched(index)
    remove(spark, index.folder)
    return out


@query(SEARCH_SQL)
def search_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranks from an index that got its texts in three batches: counts and lengths are those of all."""
    index, docs = TextIndex(spark, shared_path(spark, "index"), buckets=8), table(spark, sf_dir, "documents")
    for n in range(3):
        index.add(docs.filter(F.pmod("doc_id", F.lit(3)) == n), "doc_id", "text")
    out = _searched(index)
    remove(spark, index.folder)
    return out


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM documents), p AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS pos FROM w),
s AS (SELECT doc_id, pos, {_stem_sql('word')} AS term FROM p)
SELECT a.doc_id, count(*) AS n FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = {_stem_sql("'general'")} AND b.term = {_stem_sql("'public'")} GROUP BY 1""")
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document has two words next to one another, by the positions of an index."""
    index = TextIndex(spark, shared_path(spark, "index"), buckets=8)
    index.add(table(spark, sf_dir, "documents"), "doc_id", "text")
    out = cut(index.phrase(["general", "public"]).select(F.col("key").alias("doc_id"), F.col("n").cast("long").alias("n")))
    remove(spark, index.folder)
    return out
