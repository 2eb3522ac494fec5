"""Benchmark decontamination by a prefix-filtered set join.

A window is 13 consecutive words of an item (a shorter item is one window), and it
must be contained whole, so one element of it is a sufficient prefix: its rarest
shingle by counts over all documents. Documents' shingles are joined with these
prefixes alone; length and position bounds leave the windows that fit around a hit,
and the words of the window are then compared one by one.

Defined cases: a null text counts as empty and has no words; an item without words
has no window; repeated items are items of their own; repeated documents are each
judged; a document without words is clean; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, cut, unused, utf8
from .kgrams import Scanner, key_of

FOUND = "struct<n_words:long,cand:array<struct<p:int,key:long,around:array<int>>>>"


class Index:
    """What tasks need to find a block's shingles: the ids of its words, and the keys of its shingles by their length. As large as the block's words, at most."""

    def __init__(self, items: DataFrame, window: int, k: int):
        """items: (row, item, t)."""
        spark, self.window, self.k = items.sparkSession, window, k

        @F.arrow_udf("array<binary>")
        def words(texts: pa.Array) -> pa.Array:
            return pa.array([sorted(set(alnum_words(t))) for t in texts.to_pylist()], pa.list_(pa.binary()))

        found = items.select(F.explode(words("t")).alias("w")).distinct().toArrow()["w"].to_pylist()
        self.vocabulary = {w: n for n, w in enumerate(sorted(found), 1)}
        known = spark.sparkContext.broadcast(self.vocabulary)

        @F.arrow_udf("struct<ids:array<int>,keys:array<long>>")
        def shingles(texts: pa.Array) -> pa.Array:
            ids = [[known.value[w] for w in alnum_words(t)] for t in texts.to_pylist()]
            keys = [[key_of(x[i : i + k]) for i in range(max(1, len(x) - k + 1))] if x else [] for x in ids]
            return pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))], ["ids", "keys"])

        #: (row, item, ids, keys): the items that have words. An item of fewer words than a shingle is one.
        self.items = cut(items.select("row", "item", shingles("t").alias("s")).select("row", "item", "s.ids", "s.keys").filter(F.size("ids") > 0))
        self.keys = self._by_length(self.items.select(F.least(F.lit(k), F.size("ids")).alias("k"), F.explode("keys").alias("key")))

    @staticmethod
    def _by_length(keys: DataFrame) -> dict[int, np.ndarray]:
        found = keys.distinct().toArrow()
        of, key = found["k"].to_numpy(), found["key"].to_numpy()
        return {int(j): np.sort(key[of == j]) for j in np.unique(of)}

    def prefixes(self, counts: DataFrame) -> DataFrame:
        """(key, item, offset, ids) of each distinct window of each item: the rarest shingle in it and where that stands; ties go to the smaller key. counts: (key, n)."""
        window, k = self.window, self.k
        each = self.items.select("row", F.posexplode("keys").alias("p", "key")).join(counts, "key", "left")
        order = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("p", F.coalesce("n", F.lit(0)).alias("n"), "key"))).alias("o"))

        @F.arrow_udf("array<struct<key:long,offset:int,ids:array<int>>>")
        def windows(ids: pa.Array, n: pa.Array, keys: pa.Array) -> pa.Array:
            out = []
            for x, count, key in zip(ids.to_pylist(), n.to_pylist(), keys.to_pylist(), strict=True):
                w, rank = min(window, len(x)), list(zip(count, key, strict=True))
                span = w - min(k, len(x)) + 1
                rows = set()
                for i in range(len(x) - w + 1):
                    (_, least), offset = min((rank[i + o], o) for o in range(span))
                    rows.add((least, offset, tuple(x[i : i + w])))
                out.append([{"key": a, "offset": b, "ids": c} for a, b, c in rows])
            return pa.array(out, pa.list_(pa.struct([("key", pa.int64()), ("offset", pa.int32()), ("ids", pa.list_(pa.int32()))])))

        found = self.items.join(order, "row").select("item", windows("ids", F.col("o.n"), "keys").alias("w"))
        return cut(found.select("item", F.explode("w").alias("w")).select("w.key", "item", "w.offset", "w.ids").distinct())


def shingle_counts(docs: DataFrame, text_col: str, index: Index) -> DataFrame:
    """(key, n): how often each shingle of the block stands in all documents."""
    known = docs.sparkSession.sparkContext.broadcast((index.vocabulary, index.keys))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, total = Scanner(*known.value), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, _, _ = scanner.read(batch.column(0)[at : at + 256].to_pylist())
                for key, n in zip(*(x.tolist() for x in np.unique(scanner.find(ids)[1], return_counts=True)), strict=True):
                    total[key] = total.get(key, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["key", "n"])

    return docs.select(utf8(text_col).alias("t")).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def candidates(docs: DataFrame, index: Index, prefixes: DataFrame) -> DataFrame:
    """docs' row and id with n_words and the places of prefix shingles, each with the word ids around it (0: not the block's; -1: outside the text)."""
    wanted = index._by_length(prefixes.select(F.least(F.lit(index.k), F.size("ids")).alias("k"), "key"))
    known = docs.sparkSession.sparkContext.broadcast((index.vocabulary, wanted))
    before, width = index.window - 1, 2 * index.window - 1
    made: list[Scanner] = []

    @F.arrow_udf(FOUND)
    def scanned(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Scanner(*known.value))
        sizes_, offsets, places, found, around = [], [0], [], [], []
        for at in range(0, len(texts), 256):
            ids, starts, sizes = made[0].read(texts[at : at + 256].to_pylist())
            p, key = made[0].find(ids)
            of_text = np.searchsorted(starts, p, side="right") - 1
            own = p - starts[of_text]
            spread = np.arange(width) - before
            where = p[:, None] + spread
            near = ids[np.clip(where, 0, len(ids) - 1)]
            inside = (own[:, None] + spread >= 0) & (own[:, None] + spread < sizes[of_text][:, None])
            around.append(np.where(inside, near, -1).astype(np.int32).ravel())
            sizes_.append(sizes)
            places.append(own)
            found.append(key)
            offsets += (offsets[-1] + np.cumsum(np.bincount(of_text, minlength=len(sizes)))).tolist()
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        n = offsets[-1]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(join(around).astype(np.int32)))
        cand = pa.StructArray.from_arrays([pa.array(join(places).astype(np.int32)), pa.array(join(found)), lists], ["p", "key", "around"])
        return pa.StructArray.from_arrays([pa.array(join(sizes_)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cand)], ["n_words", "cand"])

    return docs.select("row", "id", F.xxhash64("__text").alias("raw"), scanned(F.col("__text")).alias("s")).select("row", "id", "raw", "s.n_words", "s.cand")


def window_hits(found: DataFrame, index: Index, prefixes: DataFrame) -> DataFrame:
    """(row, item, first, stop): verified occurrences of windows."""
    places = found.filter(F.size("cand") > 0).select("row", "n_words", F.explode("cand").alias("c")).select("row", "n_words", "c.*")
    first, length = F.col("p") - F.col("offset"), F.size("ids")
    fits = (first >= 0) & (first + length <= F.col("n_words"))
    same = F.slice("around", F.lit(index.window) - F.col("offset"), length) == F.col("ids")
    return places.join(prefixes, "key").filter(fits & same).select("row", "item", first.alias("first"), (first + length).alias("stop"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, k: int = 5, per: int = 20, block_bytes: int = 16 << 20) -> DataFrame:
    """(id_col, n_words, n_hit, items, contaminated), one row for each of docs; items: sorted ids, as strings, of the items that occur.

    contaminated: at least one in `per` words is hit. The benchmark is taken in blocks
    of about block_bytes of text, each in two passes over docs; a block's words and
    shingle keys are broadcast, its windows stay in Spark.
    """
    found = _found(docs, benchmark, id_col, text_col, item_col, item_text, window, k, per, block_bytes)
    return found.select(F.col("id").alias(id_col), "n_words", "n_hit", "items", "contaminated")


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, window: int, k: int, per: int, block_bytes: int) -> DataFrame:
    """contamination() with `raw`, a hash of the text."""
    items = cut(benchmark.select(F.monotonically_increasing_id().alias("row"), F.col(item_col).alias("item"), utf8(item_text).alias("t")))
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes))
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), utf8(text_col).alias("__text"))
    if blocks > 1:
        source = cut(source)  # read once for each block: `row` must stay the same
    hits, read = None, None
    for block in range(blocks):
        index = Index(items.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block), window, k)
        prefixes = index.prefixes(shingle_counts(docs, text_col, index))
        found = cut(candidates(source, index, prefixes))
        got = window_hits(found, index, prefixes)
        hits = got if hits is None else hits.union(got)
        read = found.select("row", "id", "raw", "n_words") if read is None else read
    # the union of a row's occurrences: sorted by start, each adds what reaches beyond the furthest stop so far
    runs = F.array_sort(F.collect_set(F.struct("first", "stop")))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(acc["end"], x["first"]))).alias("n"), F.greatest(acc["end"], x["stop"]).alias("end"))
    union = F.aggregate("runs", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]
    by_row = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"), runs.alias("runs")).select("row", "items", union.cast("long").alias("n_hit"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return read.join(by_row, "row", "left").select(
        "id", "raw", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * per >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, k: int = 5, per: int = 20, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of docs that are not contaminated. Of rows that share an id, or have none, those go whose own text is."""
    name, digest = unused(docs, "__bad", "__raw")
    bad = _found(docs, benchmark, id_col, text_col, item_col, item_text, window, k, per, block_bytes).filter("contaminated").select(F.col("id").alias(name), F.col("raw").alias(digest)).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(F.col(name)) & (F.xxhash64(utf8(docs[text_col])) == F.col(digest)), "left_anti")
