"""Edit-aware token counts over segment trees of pre-tokens.

A text is cut by the tokenizer's own pre-token pattern; byte-pair merges never
cross a cut, so a text's token count is the sum over its pre-tokens. Blocks of
pre-tokens are the leaves of a tree that sums characters, tokens and pre-tokens.
build_trees() makes a table of texts with their leaves; it is kept, and a batch of
edits needs no more than the trees of the documents that it names: an edit finds its
leaf by descending the character sums, splits the touched leaves and one leaf of
context before them anew, until a cut falls on the end of a leaf, encodes only those
pre-tokens, and renews the sums on the way up.

Defined cases: a null text counts as empty (0 tokens); offsets are code points,
clipped to the text; a null replacement deletes; edits apply in their listed order,
each to the text that the one before left; rows may repeat an id, and an edit of an id
is made in all its rows; a null id has no edits; one pre-token may be as long as the text.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: The pre-token pattern that belongs to the byte-level BPE vocabularies in use: fixed values.
BYTE_BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens of a new leaf; a leaf is split when it has twice as many.
LEAF = 16
EDITS = "array<struct<start:int,stop:int,put:string>>"
SUMS = ("chars", "tokens", "pretokens")
TREE = ", ".join(f"{s} array<int>" for s in SUMS)


class Counter:
    """Counts tokens of pre-tokens; remembers the counts of up to `room` short ones."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, room: int = 200_000):
        self.split = regex.compile(pattern).findall
        self.matches = regex.compile(pattern).finditer
        # the pieces are cut already: each is merged as a whole, however long
        self.encoding = tiktoken.Encoding("counted", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}
        self.room = room

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(self.known) < self.room and len(piece) <= 32:
                self.known[piece] = n
        return n

    def leaves(self, pieces: list[str], size: int | None = None) -> np.ndarray:
        """Rows of characters, tokens and pre-tokens; a column for each block of `size` pieces (LEAF)."""
        n, known = len(pieces), self.known.get
        if not n:
            return np.zeros((3, 0), np.int64)
        each = np.empty((3, n), np.int64)
        each[0] = np.fromiter(map(len, pieces), np.int64, n)
        each[1] = np.fromiter([known(p) or self.count(p) for p in pieces], np.int64, n)
        each[2] = 1
        return np.add.reduceat(each, np.arange(0, n, size or LEAF), axis=1)


class PretokenTree:
    """A text and the sums over its leaves, in a heap: a node has the sums of the two nodes at twice its place."""

    def __init__(self, text: str, leaves: np.ndarray, counter: Counter):
        self.text, self.counter = text, counter
        self._build(leaves)

    @classmethod
    def of(cls, text: str, counter: Counter) -> PretokenTree:
        return cls(text, counter.leaves(counter.split(text)), counter)

    def _build(self, leaves: np.ndarray) -> None:
        self.n, self.size = leaves.shape[1], 1
        while self.size < self.n:
            self.size *= 2
        self.nodes = np.zeros((3, 2 * self.size), np.int64)
        self.nodes[:, self.size : self.size + self.n] = leaves
        self._renew(self.size, 2 * self.size - 1)

    def _renew(self, low: int, high: int) -> None:
        """The sums above the nodes from low to high, on their way up."""
        while low > 1:
            low, high = low // 2, high // 2
            self.nodes[:, low : high + 1] = self.nodes[:, 2 * low : 2 * high + 2].reshape(3, -1, 2).sum(axis=2)

    @property
    def leaves(self) -> np.ndarray:
        return self.nodes[:, self.size : self.size + self.n]

    @property
    def total(self) -> tuple[int, int, int]:
        """Characters, tokens, pre-tokens."""
        return tuple(self.nodes[:, 1].tolist())

    def _find(self, offset: int) -> tuple[int, int]:
        """The leaf that holds the character, and where it starts."""
        node, start, chars = 1, 0, self.nodes[0]
        while node < self.size:
            node *= 2
            if start + chars[node] <= offset:
                start += int(chars[node])
                node += 1
        return node - self.size, start

    def edit(self, start: int, stop: int, put: str) -> int:
        """Replaces characters [start, stop); returns how many pre-tokens were encoded again."""
        length = len(self.text)
        start = min(max(start, 0), length)
        stop = min(max(stop, start), length)
        if start == stop and not put:
            return 0
        self.text = self.text[:start] + put + self.text[stop:]
        if not length:
            self._build(self.counter.leaves(self.counter.split(self.text)))
            return self.total[2]
        # a cut looks one character ahead, and a space may join the next word: two characters and a leaf of context
        first, at = self._find(max(start - 2, 0))
        if at:
            first, at = self._find(at - 1)
        last, last_at = self._find(max(stop - 1, 0))
        end_of_leaf = last_at + int(self.leaves[0, last]) + len(put) - (stop - start)
        pieces: list[str] = []
        if end_of_leaf > at:
            for m in self.counter.matches(self.text, at):
                pieces.append(m.group())
                while m.end() > end_of_leaf and last + 1 < self.n:
                    last += 1
                    end_of_leaf += int(self.leaves[0, last])
                # from a cut on that was one before the edit, all cuts are as they were
                if m.end() == end_of_leaf:
                    break
        slots = last - first + 1
        size = max(1, -(-len(pieces) // slots))
        if size > 2 * LEAF:
            old = self.leaves
            self._build(np.concatenate([old[:, :first], self.counter.leaves(pieces), old[:, last + 1 :]], axis=1))
        else:
            fresh = self.counter.leaves(pieces, size)
            self.leaves[:, first : last + 1] = 0
            self.leaves[:, first : first + fresh.shape[1]] = fresh
            self._renew(self.size + first, self.size + last)
        return len(pieces)


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A .tiktoken vocabulary: base64 token and rank on each line; fixed in size by its publisher. A path with a scheme is read by Spark, another one from the driver's disk; the tasks get the ranks by broadcast."""
    if "://" in path:
        lines = [r.value for r in spark.read.text(path).collect()]
    else:
        with open(path) as file:
            lines = file.read().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def _counters(spark: SparkSession, vocabulary: str, pattern: str):
    """A function for the tasks: the counter, made once in each Python worker."""
    ranks, made = spark.sparkContext.broadcast(read_ranks(spark, vocabulary)), []

    def counter() -> Counter:
        if not made:
            made.append(Counter(ranks.value, pattern))
        return made[0]

    return counter


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int32)))


def build_trees(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = BYTE_BPE_PATTERN, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, text, chars, tokens, pretokens) and the columns `keep`: each text with the sums of its leaves. To be written as a table, and kept."""
    counter = _counters(docs.sparkSession, vocabulary, pattern)

    @F.arrow_udf(f"struct<{TREE.replace(' array', ':array')}>")
    def built(texts: pa.Array) -> pa.Array:
        c = counter()
        found = [c.leaves(c.split(t or "")) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([_lists([f[i] for f in found]) for i in range(3)], list(SUMS))

    read = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"), built(F.col(text_col)).alias("__tree"), *[F.col(f"`{c}`") for c in keep])
    return read.select(id_col, "text", *[f"__tree.{s}" for s in SUMS], *keep)


def edit_trees(trees: DataFrame, vocabulary: str, id_col: str = "doc_id", edits_col: str = "edits", pattern: str = BYTE_BPE_PATTERN, keep_text: bool = True) -> DataFrame:
    """(id_col, text, chars, tokens, pretokens, reencoded): the trees after each row's edits (EDITS, in edits_col).

    reencoded: pre-tokens encoded again. Without keep_text the new texts are left out.
    """
    counter = _counters(trees.sparkSession, vocabulary, pattern)

    @F.arrow_udf(f"struct<text:string,{TREE.replace(' array', ':array')},reencoded:long>")
    def edited(texts: pa.Array, chars: pa.Array, tokens: pa.Array, pretokens: pa.Array, edits: pa.Array) -> pa.Array:
        c, made, again = counter(), [], []
        sums = [(x.offsets.to_numpy(), x.values.to_numpy()) for x in (chars, tokens, pretokens)]
        for i, (text, changes) in enumerate(zip(texts, edits, strict=True)):
            leaves = np.array([values[offsets[i] : offsets[i + 1]] for offsets, values in sums], np.int64)
            tree = PretokenTree(text.as_py(), leaves, c)
            again.append(sum(tree.edit(e["start"] or 0, e["stop"] or 0, e["put"] or "") for e in changes.as_py() or [] if e is not None))
            made.append(tree)
        kept = pa.array([t.text if keep_text else None for t in made], pa.string())
        return pa.StructArray.from_arrays([kept, *[_lists([t.leaves[i] for t in made]) for i in range(3)], pa.array(again, pa.int64())], ["text", *SUMS, "reencoded"])

    return trees.select(F.col(id_col), edited("text", *SUMS, edits_col).alias("__tree")).select(id_col, *([] if not keep_text else ["__tree.text"]), *[f"__tree.{s}" for s in SUMS], "__tree.reencoded")


def total(column: str):
    """The sum of a tree's leaves."""
    return F.aggregate(column, F.lit(0).cast("long"), lambda a, b: a + b)


def apply_edits(trees: DataFrame, edits: DataFrame, vocabulary: str, id_col: str = "doc_id", seq_col: str = "seq", pattern: str = BYTE_BPE_PATTERN) -> DataFrame:
    """The table of trees after a batch of edits (id_col, seq_col, start, stop, put). Documents that the batch does not name pass as they are."""
    joined = attach_edits(trees, edits, id_col, seq_col)
    made = edit_trees(joined.filter("edits is not null"), vocabulary, id_col, "edits", pattern)
    rest = joined.filter("edits is null").select(id_col, "text", *SUMS, F.lit(0).cast("long").alias("reencoded"))
    return rest.union(made)


def count_with_edits(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", pattern: str = BYTE_BPE_PATTERN) -> DataFrame:
    """(id_col, n_tokens, n_pretokens, edited_tokens, edited_chars, reencoded): counts before and after each row's edits.

    docs has the edits of each row as EDITS in edits_col; attach_edits() puts them
    there from a table. The trees are written to the shared folder and edited from there.
    """
    trees = cut(build_trees(docs.withColumn("__edits", F.col(edits_col)), vocabulary, id_col, text_col, pattern, keep=("__edits",)).withColumnRenamed(id_col, "__id"))
    counted = trees.select(F.struct("__id", total("tokens").alias("n_tokens"), total("pretokens").alias("n_pretokens")).alias("__was"), "text", *SUMS, "__edits")
    made = edit_trees(counted, vocabulary, "__was", "__edits", pattern, keep_text=False)
    return made.select(F.col("__was.__id").alias(id_col), "__was.n_tokens", "__was.n_pretokens", total("tokens").alias("edited_tokens"), total("chars").alias("edited_chars"), "reencoded")


def attach_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", seq_col: str = "seq") -> DataFrame:
    """docs with the column `edits` (in place of one that has the name): what the table edits (id_col, seq_col, start, stop, put) has for each id, in the order of seq_col; null where it has none."""
    each = edits.groupBy(F.col(id_col).alias("__id")).agg(F.array_sort(F.collect_list(F.struct(F.col(seq_col).alias("seq"), F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), "put"))).alias("__each"))
    listed = F.transform("__each", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["put"].alias("put")))
    return docs.join(each, docs[id_col] == F.col("__id"), "left").withColumn("edits", listed.cast(EDITS)).drop("__id", "__each")
