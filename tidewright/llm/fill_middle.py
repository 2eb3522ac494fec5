"""Fill-in-middle: texts cut in three and put in another order, the cuts found by rank on a wavelet matrix.

The bytes of many texts are one sequence of character classes. A wavelet matrix over it
counts the bytes of any class before any place; sums of such ranks count the units
(code points, words, tokens, lines) before a place. A cut after k units lies where unit k + 1
starts, or at the text's end: bisection on those counts finds it, for all texts of a slice
at once. Cuts are drawn from a hash of the seed and the id, so a rerun makes the same ones.

Defined cases: a null text counts as empty; an empty text, and one that holds a marker, stays
plain; a null id is drawn for like the id of no digits; rows that repeat an id are cut by the
same draws, each in its own text; white space outside ASCII counts as a word's character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Markers before the prefix, the suffix and the middle: fixed values of the contract.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Classes of bytes: a later byte of a character, a line end, other white space, a mark, a word's first character, its others.
LATER, LINE, SPACE, MARK, WORD, INNER = range(6)
LEVELS = 3
#: Classes of the bytes that start a unit.
UNITS = {"char": (LINE, SPACE, MARK, WORD, INNER), "word": (WORD,), "token": (MARK, WORD), "line": (LINE,)}
KINDS = np.array([LATER if 128 <= b < 192 else LINE if b == 10 else SPACE if b in b" \t\r\v\f" else WORD if b >= 192 or chr(b).isalnum() else MARK for b in range(256)], np.uint8)
#: Bytes of text whose matrix is held at a time; one text may have more.
SLICE = 1 << 22


def classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8 texts that start at `starts`. A text's first character is never inside a word."""
    kind = KINDS[data]
    inside = np.zeros(len(kind), bool)
    inside[1:] = (kind[1:] == WORD) & ((kind[:-1] == WORD) | (kind[:-1] == LATER))
    inside[starts[starts < len(kind)]] = False
    kind[inside] = INNER
    return kind


class WaveletMatrix:
    """Ranks over a sequence of small numbers: one bit vector a level, stably parted by the bit before the next."""

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS):
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        self.levels = levels
        for level in reversed(range(levels)):
            bits = (symbols >> level) & 1
            packed = np.packbits(bits, bitorder="little")
            words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.before.append(np.cumsum(ones) - ones)
            one = bits.astype(bool)
            self.zeros.append(int(len(bits) - one.sum()))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & below).astype(np.int64)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` symbols are this one."""
        at = np.append(at, 0)  # the last: where the symbol's own run starts
        for level in range(self.levels):
            ones = self._ones(level, at)
            at = self.zeros[level] + ones if symbol >> (self.levels - 1 - level) & 1 else at - ones
        return at[:-1] - at[-1]

    def count(self, of: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """How many of the first `at` symbols are among these, by the fewer ranks: theirs or the others'."""
        others = [c for c in range(INNER + 1) if c not in of]
        if len(others) < len(of):
            return at - sum((self.rank(c, at) for c in others), np.zeros_like(at))
        return sum((self.rank(c, at) for c in of), np.zeros_like(at))

    def select(self, of: tuple[int, ...], low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """For each pair of places the last one up to `high` that has k of these symbols between `low` and itself, by bisection on ranks."""
        most, low, high = self.count(of, low) + k, low.copy(), high.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            fits = self.count(of, middle) <= most
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low


def cut_places(data: np.ndarray, ends: np.ndarray, draws: np.ndarray, unit: str) -> np.ndarray:
    """Columns for each text: units, code points, bytes before the cuts, code points before the cuts.

    data: the texts' bytes one after the other; ends: where each starts, and the last one's
    end; draws: two numbers for each text.
    """
    starts, stops = ends[:-1], ends[1:]
    matrix, of = WaveletMatrix(classes(data, starts)), UNITS[unit]
    base, chars = matrix.count(of, starts), matrix.count(UNITS["char"], starts)
    n = matrix.count(of, stops) - base
    k = np.sort(draws % (n + 1), axis=0)
    cuts = [matrix.select(of, starts, stops, x) for x in k]
    return np.stack([n, matrix.count(UNITS["char"], stops) - chars, *[c - starts for c in cuts], *[matrix.count(UNITS["char"], c) - chars for c in cuts]])


def draw(id_col: str, nth: int, seed: int = 1) -> Column:
    """A number from 0 to 2^32 - 1: the nth group of eight hex digits of the SHA-256 of seed, colon, id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * nth - 7, 8), 16, 10).cast("long")


CUTS = "struct<units:long,chars:long,first:int,second:int,first_chars:long,second_chars:long>"


def _cuts(texts: pa.Array, a: pa.Array, b: pa.Array, units: pa.Array) -> pa.Array:
    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    draws = np.stack([a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False)])
    made, low = [], 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(at, at[low] + SLICE, "right")) - 1)
        made.append(cut_places(data[at[low] : at[high]], at[low : high + 1] - at[low], draws[:, low:high], units[0].as_py()))
        low = high
    found = np.concatenate([np.zeros((6, 0), np.int64), *made], axis=1)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    return pa.StructArray.from_arrays([pa.array(x).cast(k) for x, k in zip(found, kinds, strict=True)], ["units", "chars", "first", "second", "first_chars", "second_chars"])


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output): each text as it is (plain), or cut in three at units, as prefix, suffix, middle (psm) or suffix, prefix, middle (spm).

    n: code points. plain_percent of the texts stay plain, spm_percent of the others are
    spm. Nothing is shuffled; Python gets the texts and gives back places only.
    """
    if unit not in UNITS:
        raise ValueError(f"unit: one of {', '.join(UNITS)}")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *[draw(id_col, n, seed).alias(f"h{n}") for n in (1, 2, 3, 4)])
    found = texts.withColumn("c", F.arrow_udf(_cuts, CUTS)("t", "h1", "h2", F.lit(unit)))
    bare = (F.col("t") == "") | F.col("t").contains(PREFIX) | F.col("t").contains(SUFFIX) | F.col("t").contains(MIDDLE) | (F.col("h3") % 100 >= 100 - plain_percent)
    found = found.withColumn("form", F.when(bare, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm"))
    raw = F.col("t").cast("binary")
    part = lambda start, n: F.substring(raw, start + 1, n).cast("string")
    prefix, middle, suffix = part(F.lit(0), F.col("c.first")), part(F.col("c.first"), F.col("c.second") - F.col("c.first")), part(F.col("c.second"), F.octet_length("t"))
    put = F.when(F.col("form") == "plain", F.col("t")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    moved = F.col("form") != "plain"
    return found.select(
        F.col("id").alias(id_col), F.col("c.chars").alias("n"), "form", F.when(moved, F.col("c.first_chars")).alias("prefix_chars"),
        F.when(moved, F.col("c.second_chars") - F.col("c.first_chars")).alias("middle_chars"), put.alias("output"),
    )


def restored(output: str | Column, form: str | Column) -> Column:
    """The text that an output was made of. The texts hold no marker, so the first of each kind is the one that was put."""
    output, form = F.col(output) if isinstance(output, str) else output, F.col(form) if isinstance(form, str) else form
    after = lambda text, mark: F.substring(text, F.instr(text, mark) + len(mark), F.length(text))
    before = lambda text, mark: F.substring(text, F.lit(1), F.instr(text, mark) - 1)
    psm = F.concat(before(after(output, PREFIX), SUFFIX), after(output, MIDDLE), before(after(output, SUFFIX), MIDDLE))
    spm = F.concat(before(after(output, PREFIX), MIDDLE), after(output, MIDDLE), before(after(output, SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
