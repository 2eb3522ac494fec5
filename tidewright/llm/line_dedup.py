"""Line dedup: repeated runs of lines, by prefix doubling over line-id sequences.

Each line is an id (a 128-bit hash). The suffixes of all documents' id sequences are
ranked by their first 1, 2, 4, ... ids: the rank by 2h ids follows from the ranks by h
ids at i and i+h. Suffixes of equal rank stand together in the suffix array: they are
an interval of longest common prefix h or more. A suffix alone in its interval repeats
nothing and leaves, so each round keeps repeated suffixes only. Between two powers of
two the longest common prefix with an earlier place is then found exactly, interval by
interval: each of h/2, h/4, ... lines more splits an interval by the ranks at its end.
A suffix and that length are a maximal later copy. It counts from `min_lines` lines or
`min_words` words, and its lines are deleted; of each run the earliest copy stays.
DataFrame functions only.

Defined cases: the earliest copy is the one of smallest id, then smallest hash of the
text, then line; rows with a null id come after all others; rows that agree in id and
text are documents of their own, in any order; a null text counts as empty; the empty
text is one empty line; lines part at line feeds only; overlapping copies in one
document count as copies; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

PLACE = ("row", "i")


def _with_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, t): row is unique, stays the same when read again, and orders the documents by id (nulls last), then hash of the text.

    Unique whole-number ids are that already. Other tables are sorted and written once;
    the order is the same either way.
    """
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    if dict(df.dtypes)["id"] in ("bigint", "int", "smallint", "tinyint") and df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null").isEmpty():
        return df.select(F.col("id").cast("long").alias("row"), "id", "t")
    # the last sort key only spreads rows that agree in id and text over the ranges
    order = [F.col("id").asc_nulls_last(), F.xxhash64("t"), F.col("spread")]
    placed = df.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(placed.select(F.monotonically_increasing_id().alias("row"), "id", "t"))


def numbered(groups: DataFrame, order: list[str]) -> DataFrame:
    """groups with r, the sum of n over all groups before in the order: range by range, so that no key is a window of its own."""
    placed = cut(groups.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    sizes = dict(placed.groupBy("range").agg(F.sum("n").alias("n")).collect())  # one row a partition
    before = dict(zip(sorted(sizes), [0, *accumulate(sizes[k] for k in sorted(sizes))], strict=False))
    offsets = F.array(*[F.lit(before.get(k, 0)).cast("long") for k in range(max(before, default=0) + 1)])
    inside = F.sum("n").over(Window.partitionBy("range").orderBy(*order)) - F.col("n")
    return placed.withColumn("r", F.element_at(offsets, F.col("range") + 1) + inside).drop("range")


def repeated_levels(lines: DataFrame, upto: int | None = None) -> list[tuple[int, DataFrame]]:
    """[(h, (row, i, r, first))]: for h = 1, 2, 4, ... the suffixes whose first h lines repeat.

    lines: (row, i, a, b), (a, b) the line's id. r: rank among the repeated suffixes
    by their first h ids, equal in an interval and in no other, in the order of the
    suffix array; first: the interval's earliest place. Ends when nothing repeats, or
    at the last h up to `upto`.
    """
    same = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*PLACE)).alias("first")).filter("n > 1")
    ranked = numbered(same, ["a", "b"]).select("a", "b", "r", "first")
    level = cut(lines.join(ranked, ["a", "b"]).select(*PLACE, "r", "first"))
    out, h = [(1, level)], 1
    while (upto is None or 2 * h <= upto) and not level.isEmpty():
        after = level.select("row", (F.col("i") - h).alias("i"), F.col("r").alias("r2"))
        both = cut(level.select(*PLACE, F.col("r").alias("r1")).join(after, list(PLACE)))
        same = both.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*PLACE)).alias("first")).filter("n > 1")
        ranked = numbered(same, ["r1", "r2"]).select("r1", "r2", "r", "first")
        level = cut(both.join(ranked, ["r1", "r2"]).select(*PLACE, "r", "first"))
        h *= 2
        out.append((h, level))
    return [x for x in out if x[0] == 1 or not x[1].isEmpty()]


def longest_copies(levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """(row, i, length): of each place whose line stands earlier too, the most lines from there on that stand, as a run, at an earlier place.

    The powers of two come from the levels. A place whose length lies between h and 2h
    is open. An interval that has open places is split, with all its places, by their
    ranks h/2 lines at its end: open places that fall behind another one's go on in the
    longer interval, the others in the one they have; then h/4 lines more, and so on.
    """
    later = F.col("first") != F.struct(*PLACE)
    known = reduce(DataFrame.union, [level.select(*PLACE, F.lit(h).alias("h"), "first") for h, level in levels])
    best = known.filter(later).groupBy(*PLACE).agg(F.max("h").alias("best"))
    if len(levels) == 1:
        return best.select(*PLACE, F.col("best").alias("length"))
    best = cut(best)
    at = dict(levels)
    joined = known.filter("h > 1").join(best, list(PLACE), "left")
    begun = cut(joined.select(*PLACE, F.col("h").alias("length"), "first", (later & (F.col("h") == F.col("best"))).alias("open")))
    done, state, step = [best.filter("best = 1").select(*PLACE, F.col("best").alias("length"))], None, levels[-1][0]
    interval = ["length", "first"]
    while step > 1:
        new = begun.filter(F.col("length") == step)
        state, step = new if state is None else state.union(new), step // 2
        # intervals without an open place are settled; what is joined is written out, so that Spark can split an interval that many places share
        state = state.join(cut(state.filter("open").select(*interval).distinct()), interval, "left_semi")
        ends = at[step].select("row", F.col("i").alias("end"), F.col("r").alias("r2"))
        probed = cut(state.withColumn("end", F.col("i") + F.col("length")).join(ends, ["row", "end"], "left").drop("end"))
        split = probed.filter("r2 is not null").groupBy(*interval, "r2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*PLACE)).alias("behind")).filter("n > 1").drop("n")
        met = cut(probed.join(cut(split), [*interval, "r2"], "left"))
        goes = F.coalesce(F.col("open") & (F.col("behind") != F.struct(*PLACE)), F.lit(False))
        stay = met.select(*PLACE, "length", "first", (F.col("open") & ~goes).alias("open"))
        longer = met.filter("behind is not null").select(*PLACE, (F.col("length") + step).alias("length"), F.col("behind").alias("first"), goes.alias("open"))
        state = cut(stay.union(longer))
    return reduce(DataFrame.union, [*done, state.filter("open").select(*PLACE, "length")])


def later_copies(lines: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """(row, i, length, gone): the places of lines that stand earlier too, the length of the later copy that starts there, and whether its line is deleted.

    lines: (row, i, a, b, words). A later copy counts from min_lines lines or min_words words.
    """
    found = longest_copies(repeated_levels(lines.select(*PLACE, "a", "b")))
    found = found.join(lines.select(*PLACE, "words"), list(PLACE))
    # the lines of a later copy all stand in this table, one after the other
    order = Window.partitionBy("row").orderBy("i")
    words = F.col("words").cast("long")
    for k in range(1, min_lines - 1):
        words = words + F.when(F.col("length") > k, F.lead("words", k).over(order)).otherwise(0)
    counts = (F.col("length") >= min_lines) | (words >= min_words)
    reach = F.max(F.when(F.col("counts"), F.col("i") + F.col("length"))).over(order)
    return found.withColumn("counts", counts).withColumn("gone", F.coalesce(reach > F.col("i"), F.lit(False))).select(*PLACE, "length", "gone")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 3, min_words: int = 50) -> DataFrame:
    """(id_col, n_lines, n_deleted, longest, kept): one row for each of docs.

    longest: the most lines of the document that stand, as a run, at an earlier place
    (0: none); kept: the text without later copies.
    """
    rows = _with_rows(docs, id_col, text_col)
    line = rows.select("row", F.posexplode(F.split("t", "\n", -1)).alias("i", "line"))
    words = F.size(F.filter(F.split("line", r"\s+"), lambda w: w != ""))
    lines = cut(line.select(*PLACE, F.xxhash64("line").alias("a"), F.xxhash64(F.lit("second"), F.col("line")).alias("b"), words.alias("words")))
    found = later_copies(lines, min_lines, min_words)
    facts = found.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("gone"), F.col("i")))).alias("gone"), F.max("length").alias("longest"))
    joined = rows.join(facts, "row", "left").withColumn("ls", F.split("t", "\n", -1))
    # the stretches between deleted lines
    stretches = F.zip_with(F.concat(F.array(F.lit(-1)), "gone"), F.concat("gone", F.array(F.size("ls"))), lambda a, b: F.slice("ls", a + 2, b - a - 1))
    kept = F.when(F.coalesce(F.size("gone"), F.lit(0)) == 0, F.col("t")).otherwise(F.array_join(F.flatten(stretches), "\n"))
    return joined.select(
        F.col("id").alias(id_col), F.size("ls").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("longest"), kept.alias("kept"),
    )
