"""Document fingerprints: 128-bit SimHash with permuted block tables.

Terms (pairs of neighbouring words, and the first word) are hashed to 128 bits;
each bit is the sign of the terms' vote, a term weighing 1 + ln(its count). To find
all fingerprints within r bits, the bits are cut into r+2 blocks: at least two
blocks are untouched, so with one table for each pair of blocks, that pair moved to
the front as the key, every such fingerprint meets its partner in some table.

Defined cases: a null text counts as empty; a text without words has fingerprint
zero; equal texts have equal fingerprints; in the order of documents null ids come
last and rows that repeat an id go by their text; of a single document the next one
is the document itself; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, cut, hex64, utf8

BITS = 128
CHUNK = 1 << 15


def simhash(text: bytes, seed: int = 42) -> tuple[int, int]:
    """The fingerprint as two signed longs."""
    words = alnum_words(text)
    if not words:
        return 0, 0
    count: dict[tuple[bytes, bytes], int] = {}
    for term in zip([b"", *words], words, strict=False):
        count[term] = count.get(term, 0) + 1
    digest = xxhash.xxh3_128_digest
    votes, terms = np.zeros(BITS, np.float64), list(count.items())
    for at in range(0, len(terms), CHUNK):
        part = terms[at : at + CHUNK]
        bits = np.unpackbits(np.frombuffer(b"".join(digest(b" ".join(t), seed) for t, _ in part), np.uint8).reshape(-1, BITS // 8), axis=1)
        weight = (1 + np.log(np.array([n for _, n in part], np.float32))).astype(np.float32)
        votes += 2.0 * (weight @ bits.astype(np.float32)) - weight.sum()
    high, low = np.packbits(votes > 1e-6).view(">i8")
    return int(high), int(low)


def fingerprint_udf(seed: int = 42):
    @F.arrow_udf("struct<hi:long,lo:long>")
    def fingerprint(texts: pa.Array) -> pa.Array:
        got = [simhash(t, seed) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in (0, 1)], ["hi", "lo"])

    return fingerprint


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """(id_col, hi, lo): one row for each of docs."""
    return docs.select(F.col(id_col), fingerprint_udf(seed)(utf8(text_col)).alias("f")).select(id_col, "f.hi", "f.lo")


def differing(hi: str, lo: str, hi2: str, lo2: str) -> Column:
    return F.bit_count(F.col(hi).bitwiseXOR(F.col(hi2))) + F.bit_count(F.col(lo).bitwiseXOR(F.col(lo2)))


def likeness(hi: str, lo: str, hi2: str, lo2: str) -> Column:
    return 1 - differing(hi, lo, hi2, lo2) / F.lit(float(BITS))


def as_hex(hi: str, lo: str) -> Column:
    return F.concat(hex64(hi), hex64(lo))


def block_keys(radius: int) -> Column:
    """array<struct<t,key>> of a row's hi and lo: one key for each pair of the radius + 2 blocks."""
    edges = [BITS * i // (radius + 2) for i in range(radius + 3)]
    keys = []
    for n, pair in enumerate(combinations(range(radius + 2), 2)):
        mask = sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in pair)
        parts = [x - (1 << 64) if x >> 63 else x for x in (mask >> 64, mask % (1 << 64))]
        keys.append(F.struct(F.lit(n).alias("t"), F.xxhash64(F.lit(n), F.col("hi").bitwiseAND(F.lit(parts[0])), F.col("lo").bitwiseAND(F.lit(parts[1]))).alias("key")))
    return F.array(*keys)


def within(queries: DataFrame, base: DataFrame, radius: int = 3) -> DataFrame:
    """(hi, lo, n_near): for each distinct fingerprint of queries, how many rows of base are within the radius. Exact."""
    asked = queries.select("hi", "lo").distinct().select(F.col("hi").alias("qhi"), F.col("lo").alias("qlo"), F.explode(block_keys(radius)).alias("b")).select("qhi", "qlo", "b.t", "b.key")
    there = base.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n")).select("hi", "lo", "n", F.explode(block_keys(radius)).alias("b")).select("hi", "lo", "n", "b.t", "b.key")
    met = there.join(asked, ["t", "key"]).filter(differing("hi", "lo", "qhi", "qlo") <= radius)
    # a pair may meet in several tables
    once = met.groupBy("qhi", "qlo", "hi", "lo").agg(F.first("n").alias("n"))
    return once.groupBy(F.col("qhi").alias("hi"), F.col("qlo").alias("lo")).agg(F.sum("n").alias("n_near"))


def edited(text: str, after: str) -> str:
    """The last half of the code points replaced by the first as many of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


PAIR = "pid int, id {0}, n_chars long, edited_sha256 string, hi long, lo long, ehi long, elo long, nhi long, nlo long, head binary, tail binary"


def _pair_columns(rows: list[tuple]) -> tuple:
    return tuple(zip(*rows, strict=True)) if rows else ((),) * 8


def pair_up(text: bytes, own: tuple[int, int], after: bytes, after_print: tuple[int, int], seed: int) -> tuple:
    new = edited(text.decode(), after.decode()).encode()
    return (hashlib.sha256(new).hexdigest(), *own, *simhash(new, seed), *after_print)


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """(id, n_chars, edited_sha256, hi, lo, ehi, elo, nhi, nlo): fingerprints of each text, of its edited text and of the next document (descending id; after the last, the first).

    The texts are range-partitioned and sorted by id once; each task pairs neighbours
    as it reads, and only the first and last text of each partition are joined after.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    order = [F.col("id").desc_nulls_last(), F.col("h"), F.col("row")]
    rows = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("t")).select("id", F.xxhash64("t").alias("h"), F.monotonically_increasing_id().alias("row"), "t")
    # rows that agree in id and text are interchangeable: `row` only spreads them
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "t")
    schema = PAIR.format(id_type)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, held = TaskContext.get().partitionId(), None
        ids_type = None

        def batch(ids: list, texts: list, made: list, heads: list, tails: list) -> pa.RecordBatch:
            sha, hi, lo, ehi, elo, nhi, nlo = zip(*made, strict=True)
            longs = [pa.array(x, pa.int64()) for x in (hi, lo, ehi, elo, nhi, nlo)]
            chars = pa.array([len(t.decode()) for t in texts], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([pid] * len(ids), pa.int32()), pa.array(ids, ids_type), chars, pa.array(sha, pa.string()), *longs, pa.array(heads, pa.binary()), pa.array(tails, pa.binary())], [x.split()[0] for x in schema.split(", ")])

        first = True
        for b in batches:
            ids_type = b.column(0).type
            for at in range(0, b.num_rows, 128):
                ids, texts, made, heads, tails = [], [], [], [], []
                for i, t in zip(b.column(0)[at : at + 128].to_pylist(), b.column(1)[at : at + 128].to_pylist(), strict=True):
                    own = simhash(t, seed)
                    if held:
                        ids.append(held[0])
                        texts.append(held[1])
                        made.append(pair_up(held[1], held[2], t, own, seed))
                        heads.append(held[1] if first else None)
                        tails.append(None)
                        first = False
                    held = (i, t, own)
                if ids:
                    yield batch(ids, texts, made, heads, tails)
        if held:
            made = [(None, *held[2], None, None, None, None)]
            yield batch([held[0]], [held[1]], made, [held[1] if first else None], [held[1]])

    found = cut(placed.mapInArrow(pairs, schema))
    ends = found.filter(F.col("tail").isNotNull())
    pids = sorted(r.pid for r in ends.select("pid").collect())  # one number for each partition
    following = docs.sparkSession.createDataFrame(list(zip(pids, pids[1:] + pids[:1], strict=True)), "pid int, next int")
    heads = found.filter(F.col("head").isNotNull()).select(F.col("pid").alias("next"), F.col("head").alias("after"))

    @F.arrow_udf("struct<sha:string,hi:long,lo:long,ehi:long,elo:long,nhi:long,nlo:long>")
    def closed(texts: pa.Array, after: pa.Array) -> pa.Array:
        made = [pair_up(t, simhash(t, seed), a, simhash(a, seed), seed) for t, a in zip(texts.to_pylist(), after.to_pylist(), strict=True)]
        columns = list(zip(*made, strict=True)) if made else [()] * 7
        return pa.StructArray.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["sha", "hi", "lo", "ehi", "elo", "nhi", "nlo"])

    joined = ends.join(following, "pid").join(heads, "next").select("id", "n_chars", closed("tail", "after").alias("c"))
    last = joined.select("id", "n_chars", F.col("c.sha").alias("edited_sha256"), "c.hi", "c.lo", "c.ehi", "c.elo", "c.nhi", "c.nlo")
    columns = ["id", "n_chars", "edited_sha256", "hi", "lo", "ehi", "elo", "nhi", "nlo"]
    return found.filter(F.col("tail").isNull()).select(*columns).union(last.select(*columns))
