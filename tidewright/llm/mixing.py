"""Mixing sources to target weights by Pfair scheduling.

Block k of a source with share w may not start before slot floor(k/w) and must have
run by slot ceil((k+1)/w); in each slot the released block with the earliest deadline
goes next (Baruah et al., Algorithmica 1996). No source is ever a whole block ahead
of, or behind, its share: of the weights as given, with no rounding to a period. When a
source runs out, a new phase starts with the shares of those that are left, so every row
is placed once.

The driver schedules blocks, never rows: a block is the least number of rows with which
all sources together have at most `blocks` of them, besides a last short one each. So
the schedule is bounded at every size of the input, and its steps go with `blocks` and
the number of sources. Spark numbers the rows of each source and looks their blocks up.

Defined cases: null is a source of its own; sources without a weight, or with weight
0, follow after all others; a source's last block may be short; rows that repeat an
id are all placed, in any order among those that agree in all columns; an empty table
gives an empty result; extra columns are ignored by mix() and kept by in_mix_order().
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, rows_before

#: Weights are scheduled as whole numbers of this many parts.
PARTS = 1 << 40


def phase(order: list[tuple[int, str]], left: dict[str, int]) -> list[str]:
    """The sources of the slots until one source is used up; left is counted down.

    order: (weight, source) of all sources with blocks left, largest weights first.
    Weights are whole numbers, so that releases and deadlines are exact.
    """
    total, out, ready, waiting = sum(w for w, _ in order), [], [], []
    fresh, done = 0, {}
    for slot in range(sum(left.values())):
        while waiting and waiting[0][0] <= slot:
            heapq.heappush(ready, heapq.heappop(waiting)[1:])
        # first blocks are all released at the start, the largest weight's deadline first
        if fresh < len(order) and (not ready or (-(-total // order[fresh][0]), fresh) < ready[0][:2]):
            (weight, source), rank = order[fresh], fresh
            fresh += 1
        else:
            _, rank = heapq.heappop(ready)
            weight, source = order[rank]
        done[source] = k = done.get(source, 0) + 1
        out.append(source)
        left[source] -= 1
        if not left[source]:
            return out
        heapq.heappush(waiting, (k * total // weight, -(-(k + 1) * total // weight), rank))
    return out


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> list[str]:
    """The source of every slot. Its n-th slot takes the source's n-th block."""
    out: list[str] = []
    left = {s: n for s, n in blocks.items() if n}
    while left:
        active = {s: weights.get(s) or 0.0 for s in left}
        active = {s: w for s, w in active.items() if w > 0} or {s: float(n) for s, n in left.items()}
        most = max(active.values())
        order = sorted(((max(1, round(w / most * PARTS)), s) for s, w in active.items()), key=lambda x: (-x[0], x[1]))
        still = {s: left[s] for _, s in order}
        while still:
            ran = phase(order, still)
            out += ran
            order = [x for x in order if x[1] != ran[-1]]
            del still[ran[-1]]
        left = {s: n for s, n in left.items() if s not in active}
    return out


def content(docs: DataFrame) -> Column:
    """A hash of all columns that have one: it tells rows that repeat an id apart."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))])


def _placed(docs: DataFrame, id_col: str, source_col: str, weights: dict[str | None, float] | None, blocks: int, temperature: float, tie: Column, rows_in_bucket: int = 2000) -> DataFrame:
    """docs with __block, __slot and __nth (place in the block). tie: tells rows that repeat an id apart, the same whenever docs is read."""
    spark = docs.sparkSession
    name = F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], name.alias("__src"), F.xxhash64(F.col(id_col), tie).alias("__h"))
    counted = keyed.groupBy("__src").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each source
    rows = {r["__src"]: r["n"] for r in counted}
    total = sum(rows.values())
    buckets, block_rows = 1 + total // rows_in_bucket, max(1, -(-total // blocks))
    # a source's rows in buckets by a hash of id and tie: each bucket is numbered by itself, after those before it
    keyed = keyed.withColumn("__bucket", F.pmod("__h", F.lit(buckets)))
    before = rows_before(cut(keyed.groupBy("__src", "__bucket").agg(F.count(F.lit(1)).alias("n"))), "__src")
    given = {("n" if s is None else f"s{s}"): float(w) for s, w in weights.items()} if weights is not None else {s: n**temperature for s, n in rows.items()}
    taken: dict[str, int] = {}
    plan = []
    for slot, s in enumerate(schedule({s: -(-n // block_rows) for s, n in rows.items()}, given)):
        plan.append((s, taken.get(s, 0), slot))
        taken[s] = taken.get(s, 0) + 1
    # at most `blocks` rows and one more for each source
    table = spark.createDataFrame(plan, "__src string, __block long, __slot long")
    inner = Window.partitionBy("__src", "__bucket").orderBy("__h")
    numbered = keyed.withColumn("__i", F.row_number().over(inner)).join(before, ["__src", "__bucket"]).withColumn("__i", F.col("__i") - 1 + F.col("__before"))
    numbered = numbered.withColumn("__block", F.floor(F.col("__i") / block_rows)).withColumn("__nth", (F.col("__i") % block_rows).cast("int"))
    return numbered.join(F.broadcast(table), ["__src", "__block"]).select(*[F.col(f"`{c}`") for c in docs.columns], "__block", "__slot", "__nth")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", blocks: int = 100_000, temperature: float = 0.5) -> DataFrame:
    """(id_col, source_col, block, slot, nth): where each row comes in the mixture. Without weights: each source's size to the power `temperature`."""
    # rows that agree in both are alike here; written out, since what spreads them must stay the same
    light = cut(docs.select(F.col(id_col), F.col(source_col), F.monotonically_increasing_id().alias("__tie")))
    placed = _placed(light, id_col, source_col, weights, blocks, temperature, F.col("__tie"))
    return placed.select(id_col, source_col, F.col("__block").alias("block"), F.col("__slot").alias("slot"), F.col("__nth").alias("nth"))


def in_mix_order(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", blocks: int = 100_000, temperature: float = 0.5) -> DataFrame:
    """All rows and columns of docs in the order of the mixture: a reader that takes them in turn gets the target shares."""
    # docs' columns stay in one of their own, so that none is taken for a column of the schedule
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), content(docs).alias("__tie"))
    placed = _placed(held, "__id", "__source", weights, blocks, temperature, F.col("__tie"))
    return placed.orderBy("__slot", "__nth").select(*[F.col(f"__doc.`{c}`") for c in docs.columns])


def with_places(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", blocks: int = 100_000, temperature: float = 0.5, tie: str | None = None) -> DataFrame:
    """All rows and columns of docs, with __slot and __nth: where each comes in the order of the mixture.

    tie: a column that holds content() of the rows as in_mix_order() sees them.
    """
    return _placed(docs, id_col, source_col, weights, blocks, temperature, content(docs) if tie is None else F.col(tie)).drop("__block")
