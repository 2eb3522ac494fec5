"""Cross-tokenizer alignment: tokens of two tokenizers over the same bytes, linked where they overlap.

Each text is encoded by a byte-level BPE (A) and a piece BPE (B). The tokens of the texts
of a slice lie one after the other on one line of bytes, text by text; pandas merge_asof,
keyed by document, finds for each start of an A token the B token that covers it, and the
other way round; both together are all overlaps, and equal ends part the groups. How many
documents hold a pair of ids linked is counted over all of them; the counts of a range of A
ids, `block` pairs at most, are then broadcast, and each document looks its links up. The two
vocabularies bound the pairs, and so the blocks: documents move through none of the shuffles.

Defined cases: a null or empty text, and one whose tokens do not give its bytes back, has no
tokens; repeated rows count as documents each; a null id is kept; ids may repeat.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, file_bytes
from .token_counts import BYTE_BPE_PATTERN

#: Bytes of text whose tokens are linked at a time; one text may have more.
SLICE = 1 << 20
#: Distinct pairs that a task holds before it hands its counts on.
HELD = 1 << 21
COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def byte_table() -> dict[str, int]:
    """The byte for which a character stands in a byte-level vocabulary: printable ones stand for themselves, the others are moved behind 255 in their order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class ByteBpe:
    """A byte-level BPE from its JSON file. Pre-tokens are encoded one by one, and those of up to `room` short ones are remembered: merges cross no pre-token."""

    def __init__(self, content: bytes, room: int = 400_000):
        read = json.loads(content)
        kind, model, back = read.get("pre_tokenizer") or {}, read["model"], byte_table()
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or read.get("normalizer"):
            raise ValueError("a byte-level BPE without normalizer and with the usual pattern is needed")
        vocabulary = model["vocab"]
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids must follow the order of the merges")
        special = {t["content"] for t in read.get("added_tokens", ())}
        ranks = {bytes(back[c] for c in k): i for k, i in vocabulary.items() if k not in special}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for b, i in ranks.items():
            self.bytes[i] = b
        self.split = regex.compile(BYTE_BPE_PATTERN).findall
        self.encoding = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, list[int]] = {}
        self.room = room

    def encode(self, text: str) -> list[int]:
        out, known = [], self.known
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.encoding.encode_ordinary(piece)
                if len(known) < self.room and len(piece) <= 32:
                    known[piece] = ids
            out += ids
        return out


class PieceBpe:
    """A piece BPE from its model file; the bytes of its pieces."""

    def __init__(self, content: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        piece = self.model.id_to_piece
        self.bytes = [bytes([int(piece(i)[3:5], 16)]) if self.model.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.model.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def overlaps(a_doc: np.ndarray, a_start: np.ndarray, b_doc: np.ndarray, b_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and B tokens of all overlaps. Starts rise along each side; a document's first tokens start together."""
    a = pd.DataFrame({"doc": a_doc, "start": a_start, "a": np.arange(len(a_doc))})
    b = pd.DataFrame({"doc": b_doc, "start": b_start, "b": np.arange(len(b_doc))})
    covering_b = pd.merge_asof(a, b, on="start", by="doc")["b"].to_numpy()
    covering_a = pd.merge_asof(b, a, on="start", by="doc")["a"].to_numpy()
    fresh = a_start[covering_a] < b_start  # equal starts are there from the other direction
    return np.concatenate([np.arange(len(a_doc)), covering_a[fresh]]), np.concatenate([covering_b, np.flatnonzero(fresh)])


class Aligner:
    """Encodes and links slices of texts."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteBpe(a), PieceBpe(b)
        self.lengths = [np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b)]
        # each id as it stands in the digest's text: inside a group and at its end, on either side
        self.words = pa.array([f"{i}{end}".encode() for ends, t in ((",|", self.a), (",;", self.b)) for i in range(len(t.bytes)) for end in ends], pa.binary())

    def tokens(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        side_a = [self.a.encode(f" {t}") if t else [] for t in texts]
        side_b = self.b.encode([t or "" for t in texts])
        get_a, get_b = self.a.bytes.__getitem__, self.b.bytes.__getitem__
        for i, t in enumerate(texts):
            held = f" {t}".encode() if t else None
            if held is None or b"".join(map(get_a, side_a[i])) != held or b"".join(map(get_b, side_b[i])) != held:
                side_a[i], side_b[i] = [], []
        return side_a, side_b

    def align(self, texts: list[str | None]) -> tuple[list, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For each text n_a, n_b, n_groups and n_links; the digests; where each text's pairs start; the distinct pairs (A id times B's vocabulary, plus B id); how often each is linked there."""
        n, width = len(texts), len(self.b.bytes)
        sides = self.tokens(texts)
        sizes = [np.array([len(x) for x in s], np.int64) for s in sides]
        (a, b), (a_doc, b_doc) = [np.array([i for x in s for i in x], np.int64) for s in sides], [np.repeat(np.arange(n), z) for z in sizes]
        a_end, b_end = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        if not len(a):
            return [sizes[0], sizes[1], sizes[0], sizes[0]], [""] * n, np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        of_a, of_b = overlaps(a_doc, a_end - self.lengths[0][a], b_doc, b_end - self.lengths[1][b])
        a_last, b_last = b_end[np.searchsorted(b_end, a_end)] == a_end, a_end[np.searchsorted(a_end, b_end)] == b_end
        # the digest's text: a group's A tokens, then its B tokens
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        a_upto, b_upto = np.cumsum(np.bincount(a_group)), np.concatenate([[0], np.cumsum(np.bincount(b_group))])
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + b_upto[a_group]] = 2 * a + a_last
        order[np.arange(len(b)) + a_upto[b_group]] = 2 * (len(self.a.bytes) + b) + b_last
        text = self.words.take(pa.array(order))
        held, at = memoryview(text.buffers()[2]), np.frombuffer(text.buffers()[1], np.int32)
        ends = at[np.concatenate([[0], np.cumsum(sizes[0] + sizes[1])])].tolist()
        digests = [hashlib.sha256(held[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends, ends[1:], strict=False)]
        pairs, times = np.unique(a_doc[of_a] * (len(self.a.bytes) * width) + a[of_a] * width + b[of_b], return_counts=True)
        doc, pairs = np.divmod(pairs, len(self.a.bytes) * width)
        starts = np.searchsorted(doc, np.arange(n + 1))
        counted = [sizes[0], sizes[1], np.bincount(a_doc[a_last], minlength=n), np.bincount(a_doc[of_a], minlength=n)]
        return counted, digests, starts, pairs, times


def align_tokens(docs: DataFrame, byte_bpe: str, piece_bpe: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(row, id_col, COUNTS, pairs, times) of each text, and the width: pairs are A ids times the width plus B ids, each once, times how often it is linked in the text. row numbers the rows of a written result."""
    spark = docs.sparkSession
    shared, made = spark.sparkContext.broadcast((file_bytes(spark, byte_bpe), file_bytes(spark, piece_bpe))), []
    kind = docs.schema[id_col].dataType.simpleString()

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Aligner(*shared.value))
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))])
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(sizes, sizes[low] + SLICE, "right")) - 1)
                counted, digests, starts, pairs, times = made[0].align(batch.column(1).slice(low, high - low).to_pylist())
                lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x, k)) for x, k in ((pairs, pa.int64()), (times, pa.int32()))]
                numbers = pa.array(np.arange(row, row + high - low))
                yield pa.RecordBatch.from_arrays([numbers, batch.column(0).slice(low, high - low), *[pa.array(c, pa.int64()) for c in counted], pa.array(digests, pa.string()), *lists], ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                row, low = row + high - low, high

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    width = sentencepiece.SentencePieceProcessor(model_proto=shared.value[1]).get_piece_size()
    return read.mapInArrow(aligned, f"row long, id {kind}, {COUNTS}, pairs array<long>, times array<int>"), width


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many rows hold each pair. A task adds its rows up before it hands anything on, HELD pairs at a time."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])
        for batch in batches:
            fresh, count = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            merged, at = np.unique(np.concatenate([keys, fresh]), return_inverse=True)
            keys, n = merged, np.bincount(at, np.concatenate([n, count]), len(merged)).astype(np.int64)
            if len(keys) > HELD:
                yield out()
                keys, n = keys[:0], n[:0]
        yield out()

    return aligned.select("pairs").mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _blocks(counts: DataFrame, width: int, block: int) -> list[tuple[int, int]]:
    """Ranges of pairs, `block` of them at most and all those of an A id together. What reaches the driver is one row for an A id."""
    sizes = sorted(counts.groupBy(F.floor(F.col("pair") / width).alias("a")).count().collect())
    cuts, held = [0], 0
    for a, n in sizes:
        if held and held + n > block:
            cuts.append(a)
            held = 0
        held += n
    return [(x * width, y * width) for x, y in zip(cuts, [*cuts[1:], (sizes[-1][0] if sizes else 0) + 1], strict=True)]


def _looked_up(aligned: DataFrame, spark: SparkSession, counts: DataFrame, width: int, low: int, high: int) -> DataFrame:
    """aligned without its pairs, with n_best and count_sum over the pairs of one block."""
    got = counts.filter((F.col("pair") >= low) & (F.col("pair") < high)).toArrow()  # one block
    keys, n = (got[c].to_numpy() for c in ("pair", "n"))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.diff(keys // width, prepend=-1))
    best = np.repeat(np.maximum.reduceat(n, first), np.diff(first, append=len(n))) if len(n) else n
    shared = spark.sparkContext.broadcast((keys, n, n == best))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = shared.value
        for batch in batches:
            pairs, times = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            ends = np.concatenate([[0], np.cumsum(np.diff(pairs.offsets.to_numpy()))])
            pair, often = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            inside = (pair >= low) & (pair < high)
            at = np.searchsorted(keys, np.where(inside, pair, low))
            at[~inside] = 0
            sums = [np.concatenate([[0], np.cumsum(np.where(inside, x, 0))]) for x in ((often * best[at], often * n[at]) if len(keys) else (often * 0, often * 0))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *[pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums]], [*batch.schema.names[:-2], "n_best", "count_sum"])

    kept = aligned.schema.names[:-2]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema if f.name in kept)
    return aligned.mapInArrow(looked_up, f"{kinds}, n_best long, count_sum long")


def alignment(docs: DataFrame, byte_bpe: str, piece_bpe: str, id_col: str = "doc_id", text_col: str = "text", block: int = 1 << 22) -> DataFrame:
    """(id_col, COUNTS, n_best, count_sum): how the two tokenizations of each text lie on each other, and how usual its links are.

    n_best: links whose pair is in as many documents as any pair of its A id; count_sum: the
    sum over the links of the documents that hold the pair. The links are written once, and
    read once for the counts and once for each block of counts.
    """
    spark = docs.sparkSession
    found, width = align_tokens(docs, byte_bpe, piece_bpe, id_col, text_col)
    found = cut(found)
    counts = cut(pair_counts(found))
    parts = [_looked_up(found, spark, counts, width, *b) for b in _blocks(counts, width, block)]
    if len(parts) == 1:
        out = parts[0]
    else:
        same = [c for c in parts[0].columns if c not in ("n_best", "count_sum")]
        every = parts[0]
        for p in parts[1:]:
            every = every.union(p)
        out = every.groupBy(*same).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.drop("row").withColumnRenamed("id", id_col)
