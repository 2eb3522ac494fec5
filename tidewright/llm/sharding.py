"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (Mirrokni, Thorup, Zadimoghaddam, SODA 2018).

Keys and virtual nodes are hashed to a ring of cells; a key goes clockwise to the
next virtual node whose shard has room. A cell's keys all see the same shards, so
only the cells' counts reach the driver, which lets the cells arrive in a hashed order
and notes which stretch of each cell's keys goes to which shard; Spark numbers the keys
inside their cells and looks the stretch up. DataFrame functions only.

The capacity is (1 + slack) times the mean; with slack 0 the shards' capacities add up
to the number of rows, so counts differ by one at most. More slack moves fewer rows when
a shard is added.

Defined cases: a key is an id with its text, so rows that repeat an id or have none are
spread by their texts, and rows that agree in both are keys of one cell; a null text has
size 1 and the checksum of the empty text; an empty table gives an empty result; columns
other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, rows_before, utf8


def _point(name: str, size: int) -> int:
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big") % size


def ring(shards: int, cells: int, vnodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes, in ring order. A new shard only adds nodes."""
    return sorted((_point(f"node/{s}/{v}", cells), s) for s in range(shards) for v in range(vnodes))


def flows(counts: dict[int, int], shards: int, cells: int, vnodes: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """(cell, from, to, shard, slot): the cell's keys numbered from `from` to before `to` go to the shard, at its slots from `slot` on."""
    total = sum(counts.values())
    nodes = ring(shards, cells, vnodes)
    if slack:
        room = [math.ceil((1 + slack) * total / shards)] * shards
    else:
        more = sorted(range(shards), key=lambda s: _point(f"more/{s}", 1 << 62))[: total % shards]
        room = [total // shards + (s in more) for s in range(shards)]
    used, out = [0] * shards, []
    first = {c: i for i, c in reversed(list(enumerate(c for c, _ in nodes)))}
    at, start = len(nodes), [0] * cells
    for c in range(cells - 1, -1, -1):
        at = first.get(c, at)
        start[c] = at
    for cell in sorted(counts, key=lambda c: _point(f"cell/{c}", 1 << 62)):
        n, done = counts[cell], 0
        for step in range(len(nodes)):
            if done == n:
                break
            s = nodes[(start[cell] + step) % len(nodes)][1]
            if take := min(n - done, room[s] - used[s]):
                out.append((cell, done, done + take, s, used[s]))
                used[s] += take
                done += take
    return out


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", slack: float = 0.0, cells: int = 4096, vnodes: int = 64, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot) and the columns `keep` of docs: one row for each of docs; slot counts a shard's rows from 0 without gaps."""
    text = utf8(text_col)
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *[F.col(f"`{c}`").alias(f"__keep{n}") for n, c in enumerate(keep)])
    rows = rows.withColumn("h", F.xxhash64("id", "text_crc32", "size")).withColumn("cell", F.pmod(F.shiftrightunsigned("h", 20), F.lit(cells)).cast("int"))
    rows = cut(rows)  # without the texts, which are read once
    counts = {r.cell: r.n for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # `cells` rows at most
    table = docs.sparkSession.createDataFrame(flows(counts, shards, cells, vnodes, slack), "cell int, lo long, hi long, shard int, at long")
    nth = F.row_number().over(Window.partitionBy("cell").orderBy("h", "id", "size", "text_crc32")) - 1
    numbered = rows.withColumn("nth", nth)
    # at most one stretch for each cell and one more for each shard
    met = numbered.join(F.broadcast(table), (numbered["cell"] == table["cell"]) & (F.col("nth") >= F.col("lo")) & (F.col("nth") < F.col("hi")))
    return met.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("at") + F.col("nth") - F.col("lo")).cast("long").alias("slot"), *[F.col(f"__keep{n}").alias(c) for n, c in enumerate(keep)])


def slots_in_order(assigned: DataFrame, slots_in_bucket: int = 125) -> DataFrame:
    """assigned (shard, slot and others, with __slot and __nth of mixing.with_places), without these two: a shard's slots follow them, from 0 without gaps."""
    columns = [c for c in assigned.columns if c not in ("__slot", "__nth")]
    placed = cut(assigned.withColumn("__bucket", F.floor(F.col("__slot") / slots_in_bucket)))
    before = rows_before(cut(placed.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("n"))), "shard")
    nth = F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy("__slot", "__nth")) - 1
    numbered = placed.withColumn("__at", nth).join(before, ["shard", "__bucket"])
    return numbered.withColumn("slot", (F.col("__at") + F.col("__before")).cast("long")).select(*columns)
