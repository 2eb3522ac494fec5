"""SimHash near-duplicate groups by covering locality-sensitive hashing (Pagh, SODA 2016).

Fingerprints are voted by word shingles. For radius r, each of the 64 bit positions
gets a nonzero vector of r+1 bits, and each of the 2^(r+1)-1 nonzero vectors v makes
a table: it keeps the bits whose vector has an odd product with v. At most r
differing positions span at most r dimensions, so some v is orthogonal to all of
them and the pair collides in that table: no link can be missed.

near_duplicates() links fingerprints within the radius. similar_groups() links texts
whose shingle sets have a similarity: it finds them by covering tables of several
fingerprints, voted by words, and compares the sets.

Defined cases: a null text counts as empty; a text without words has fingerprint
zero, linked like any other (by similarity: such texts are copies of one another);
fewer words than the shingle length make one shingle; equal fingerprints, or word
sequences, always link; null ids are allowed and never the smallest; rows that repeat
an id are rows of their own; columns other than id and text are ignored.
"""

from __future__ import annotations

import random
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hex64, space_words, unused, utf8

BITS = 64
#: Texts of up to so many words meet by rare shingles too: a word more or less is much of a short text's fingerprint, and little of the similarity.
BRIEF = 30
#: Shingles voted at once, so that a very long text needs bounded memory.
CHUNK = 1 << 16


def shingle_hashes(words: list[bytes], k: int, seed: int) -> list[int]:
    """XXH64 of each run of k words joined by spaces; of the whole sequence if it is shorter."""
    text = b" ".join(words)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(text, seed)] if words else []
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    return [digest(text[a:b], seed) for a, b in zip(starts[: 1 - k].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)]


def majority(hashes: list[int]) -> int:
    """The 64 bits that more than half of the hashes have; zero for no hashes."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.array(hashes[at : at + CHUNK], np.uint64).view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, fp) and the columns `keep`: one row per row of docs."""

    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array([majority(shingle_hashes(space_words(t), k, seed)) for t in texts.to_pylist()], pa.int64())

    return docs.select(F.col(id_col), *keep, fingerprint(utf8(text_col)).alias("fp"))


def covering_masks(radius: int, seed: int = 1) -> list[int]:
    """The 2^(radius+1)-1 masks; every nonzero vector falls to about as many bit positions."""
    vectors = list(range(1, 2 ** (radius + 1)))
    of_bit = [vectors[i % len(vectors)] for i in range(BITS)]
    random.Random(seed).shuffle(of_bit)
    return [sum(1 << i for i in range(BITS) if (of_bit[i] & v).bit_count() % 2) for v in vectors]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_links(distinct: DataFrame, radius: int = 2, few: int = 6) -> DataFrame:
    """(a, b), a > b: pairs of fingerprints within the radius that connect exactly what all such pairs connect.

    distinct: column fp, no repeats. A bucket of up to `few` fingerprints has its
    pairs compared. A larger one is split further, whatever its size, without
    pairing its members: each sends itself to every value one flip away within the
    bits its table leaves open (radius 2), or with one open bit wiped (radius 1);
    values that two members meet in are groups of at most 65, whose members are all
    within the radius, and each is linked to the smallest.
    """
    if radius not in (1, 2):
        raise ValueError("radius 1 or 2")
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(n).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for n, m in enumerate(masks)])
    rows = distinct.select("fp", F.explode(tables).alias("b")).select("fp", "b.t", "b.key")
    shared = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = cut(rows.join(shared, ["t", "key"]))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    small = met.filter(F.col("n") <= few).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    pairs = small.select("fps", F.explode("fps").alias("a")).select("a", F.explode("fps").alias("b")).filter((F.col("a") > F.col("b")) & (apart <= radius))
    # the open bits of each table, as values to flip
    open_bits = F.array(*[F.array(*[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in masks])
    bits = F.element_at(open_bits, F.col("t") + 1)
    if radius == 2:
        values = F.array_append(F.transform(bits, lambda x: F.col("fp").bitwiseXOR(x)), F.col("fp"))
        ball = met.filter(F.col("n") > few).select("fp", "t", F.explode(values).alias("z"), F.lit(0).cast("long").alias("bit"))
    else:
        wiped = F.transform(bits, lambda x: F.struct(F.col("fp").bitwiseAND(F.bitwise_not(x)).alias("z"), x.alias("bit")))
        ball = met.filter(F.col("n") > few).select("fp", "t", F.explode(wiped).alias("w")).select("fp", "t", "w.z", "w.bit")
    stars = ball.groupBy("t", "z", "bit").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    hub = stars.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).filter(F.col("a") > F.col("b"))
    return pairs.select("a", "b").union(hub.select("a", "b")).distinct()


def connected_components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root): the smallest node reachable, for each node of a link, by alternating star contraction.

    links: (a, b), a > b. Each round hangs every node's larger neighbours, then its
    smaller ones, on the smallest it knows; rounds go with the logarithm of a
    component's size. Edges stay in Spark and are checkpointed each round.
    """
    edges = cut(links.select("a", "b").distinct())
    was = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a")
        edges = cut(hung.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").union(hung.select("a", F.col("m").alias("b"))).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == was or not now[0]:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("b").agg(F.lit(1)).select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _grouped(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(id, raw, node, component_id, pick): the group of each of rows (id, raw, node); component_id is the group's smallest id.

    pick: the (id, raw) of the row that stands for the group: smallest id, nulls last,
    then smallest hash of the text.
    """
    nodes = cut(rows.groupBy("node").agg(F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "raw")).alias("pick")))
    roots = connected_components(links)
    linked = nodes.join(roots, "node")
    groups = linked.groupBy("root").agg(F.min("least").alias("group_id"), F.min("pick").alias("group_pick"))
    named = linked.join(groups, "root").select("node", "group_id", "group_pick")
    # written out, so that both sides of the last join are plain shuffles: Spark can then split a node that many rows share
    labels = cut(nodes.join(named, "node", "left").select("node", F.coalesce("group_id", "least").alias("component_id"), F.coalesce("group_pick", "pick").alias("pick")))
    return rows.join(labels, "node").select("id", "raw", "node", "component_id", "pick")


def _near_rows(docs: DataFrame, id_col: str, text_col: str, k: int, radius: int, seed: int) -> DataFrame:
    """_grouped() by fingerprints within the radius."""
    raw = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(utf8(text_col)).alias("raw"))
    rows = cut(fingerprints(raw, "id", "text", k, seed, keep=("raw",)).withColumnRenamed("fp", "node"))
    return _grouped(rows, cut(covering_links(rows.select(F.col("node").alias("fp")).distinct(), radius)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(id_col, fingerprint, component_id): the near-duplicate group of each row.

    component_id is the smallest id reachable over links of at most `radius` differing bits.
    """
    found = _near_rows(docs, id_col, text_col, k, radius, seed)
    return found.select(F.col("id").alias(id_col), hex64("node").alias("fingerprint"), "component_id")


# ------------------------------------------------------------ by similarity


def shingle_set(words: list[bytes], k: int, seed: int) -> np.ndarray:
    """The distinct shingle hashes."""
    return np.unique(np.array(shingle_hashes(words, k, seed), np.uint64)).view(np.int64)


def word_prints(docs: DataFrame, id_col: str, text_col: str, k: int, prints: int, seed: int) -> DataFrame:
    """(id, raw, node, prints, brief): node, a digest of the words; raw, a hash of the text as it is; prints, independent fingerprints voted by the words; brief, the shingle set of a text of up to BRIEF words.

    A word votes by the square root of its count: an edit that leaves four of five
    5-word shingles changes one word in fifty, and few of a fingerprint's bits.
    """
    times, plus = (np.random.default_rng(seed).integers(0, 1 << 64, (2, prints), np.uint64) for _ in range(2))

    def bits(words: list[bytes]) -> np.ndarray:
        """A row of 64 bits for each fingerprint, for each word: its hash, mixed anew for each."""
        mixed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[:, None]
        for step, add, shift in zip(times | np.uint64(1), plus, (32, 29), strict=True):
            mixed = mixed * step + add
            mixed ^= mixed >> np.uint64(shift)
        return np.unpackbits(mixed.view(np.uint8), axis=1)

    @F.arrow_udf("struct<node:binary,prints:array<long>,brief:array<long>>")
    def made(texts: pa.Array) -> pa.Array:
        nodes, found, brief = [], [], []
        for t in texts.to_pylist():
            words = space_words(t)
            nodes.append(xxhash.xxh3_128_digest(b" ".join(words)))
            brief.append(shingle_set(words, k, seed) if len(words) <= BRIEF else None)
            count = list(Counter(words).items())
            votes = np.zeros(BITS * prints, np.float32)
            for at in range(0, len(count), 1 << 12):
                part = count[at : at + (1 << 12)]
                weight = np.sqrt(np.array([n for _, n in part], np.float32))
                votes += 2 * (weight @ bits([w for w, _ in part]).astype(np.float32)) - weight.sum()
            found.append(np.packbits(votes > 1e-3).view(np.int64))
        lists = pa.list_(pa.int64())
        return pa.StructArray.from_arrays([pa.array(nodes, pa.binary()), pa.array(found, lists), pa.array(brief, lists)], ["node", "prints", "brief"])

    text = utf8(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("raw"), made(text).alias("s")).select("id", "raw", "s.node", "s.prints", "s.brief")


def shingle_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, k: int, seed: int) -> DataFrame:
    """(node, s): the distinct shingle hashes of each of nodes (node, pick)."""

    @F.arrow_udf("array<long>")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(space_words(t), k, seed) for t in texts.to_pylist()], pa.list_(pa.int64()))

    texts = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("t")).withColumn("raw", F.xxhash64("t"))
    wanted = nodes.select("node", F.col("pick.id").alias("pid"), F.col("pick.raw").alias("praw"))
    met = texts.join(wanted, texts["id"].eqNullSafe(F.col("pid")) & (F.col("raw") == F.col("praw")))
    return met.dropDuplicates(["node"]).select("node", hashed("t").alias("s"))


def similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the pairs whose shingle sets have the similarity."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    common, total = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    return both.filter(common / F.greatest(F.lit(1), total - common) >= threshold).select("a", "b")


def table_keys(print_: Column) -> Column:
    """array<long>: a fingerprint's key in each covering table of radius 2."""
    return F.array(*[F.xxhash64(F.lit(n), print_.bitwiseAND(F.lit(_signed(m)))) for n, m in enumerate(covering_masks(2))])


def similar_links(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, k: int, threshold: float, prints: int, few: int, seed: int) -> DataFrame:
    """(a, b), a > b: pairs of nodes (node, pick, prints, brief) that connect what all verified links between nodes of a bucket connect: each with the smallest of its component.

    Nodes that agree in a covering table of one of their fingerprints share a bucket, and
    so do short texts by the rarest of their shingles, with which no pair of them is missed.
    All pairs of up to `few` nodes are compared. In a larger bucket each node is
    compared with the leader alone: the one that shares buckets with the most others,
    as the text does that the others are copies of. A bucket that the links hold
    together by then, through any leader, is settled. The nodes of the others meet anew
    by the rarest of their shingles, as many as two similar sets can't but share one of
    (rarest()), and what is open then gets four times as many leaders each round; nodes
    that hang together already are not compared. It ends when all is settled, or all
    that may lead have led.
    """
    buckets = lambda n: F.transform(table_keys(F.col("prints")[n]), lambda key: F.xxhash64(F.lit(n), key))
    rows = nodes.select("node", F.explode(F.flatten(F.array(*[buckets(n) for n in range(prints)]))).alias("bucket"), F.lit(True).alias("leads"))
    short = nodes.filter(F.size("brief") > 0).select("node", F.col("brief").alias("s"))
    met = cut(_met(rows.unionByName(rarest(short, threshold))))
    shared = met.groupBy("node").agg(F.sum("n").alias("fame"))
    sets = cut(shingle_sets(docs, nodes.join(shared, "node", "left_semi"), id_col, text_col, k, seed))
    # with the size of each set, so that pairs whose sizes rule the similarity out are never made
    fame = cut(shared.join(sets.select("node", F.size("s").alias("size")), "node"))
    near = lambda a, b: F.least(a, b) >= threshold * F.greatest(a, b) - 1
    met, links, depth = met.join(fame, "node").select("node", "bucket", "n", "fame", "size", F.col("node").alias("root"), "leads"), None, 0
    while True:
        small = met.filter(F.col("n") <= few).groupBy("bucket").agg(F.collect_list(F.struct("node", "root", "leads", "size")).alias("held"))
        pairs = small.select("held", F.explode("held").alias("a")).select("a", F.explode("held").alias("b")).filter("a.node > b.node and a.root != b.root and (a.leads or b.leads)").filter(near(F.col("a.size"), F.col("b.size"))).select("a.node", "b.node")
        large = met.filter(F.col("n") > few)
        lead = cut(_leaders(large.filter("leads"), 4 ** max(0, depth - 1), depth))
        faced = large.join(lead.select("bucket", "leader", F.col("root").alias("other"), F.col("size").alias("own")), "bucket").filter("root != other").filter(near(F.col("size"), F.col("own"))).select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b"))
        good = cut(similar(cut(pairs.toDF("a", "b").union(faced).distinct()), sets, threshold))
        if not good.isEmpty():
            components = cut(connected_components(good if links is None else links.union(good)))
            # from here on a component is a star: what held it together is not walked again
            links = components.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        if links is None:
            links, components = good, good.select(F.col("a").alias("node"), F.col("b").alias("root"))
        left = _open(large.drop("root", "n"), components)
        left = left.join(lead.select("bucket", F.col("leader").alias("node")), ["bucket", "node"], "left_anti")
        if not depth:
            # from here on by shingles: every pair of open nodes that can be similar meets again
            roots = cut(left.select("node", "root").distinct())
            left = rarest(sets.join(roots, "node", "left_semi"), threshold).join(fame, "node").join(roots, "node")
        held = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("leads").alias("some"), (F.min("root") != F.max("root")).alias("open"))
        met = cut(left.join(held.filter("some and open").select("bucket", "n"), "bucket"))
        if met.isEmpty():
            return links
        depth += 1


def _met(rows: DataFrame) -> DataFrame:
    """rows (node, bucket, leads) with n, the size of the bucket: buckets of two and more, one of which may lead."""
    held = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("leads").alias("some"))
    return rows.join(held.filter("n > 1 and some").select("bucket", "n"), "bucket")


def _leaders(large: DataFrame, leaders: int, depth: int) -> DataFrame:
    """(bucket, leader, root, size): of each of `leaders` groups of a bucket's nodes (node, bucket, fame, root, size) the most famous."""
    group = F.pmod(F.xxhash64("node", "bucket", F.lit(depth)), F.lit(leaders))
    best = large.groupBy("bucket", group.alias("j")).agg(F.max(F.struct("fame", F.xxhash64("node").alias("h"), "node", "root", "size")).alias("x"))
    return best.select("bucket", F.col("x.node").alias("leader"), "x.root", "x.size")


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members (node, bucket, fame, size, leads) of buckets that the links do not hold together, with root, the component of each."""
    named = members.join(roots, "node", "left").select("node", "bucket", "fame", "size", "leads", F.coalesce("root", "node").alias("root"))
    apart = named.groupBy("bucket").agg((F.min("root") != F.max("root")).alias("open")).filter("open").select("bucket")
    return named.join(apart, "bucket", "left_semi")


def rarest(sets: DataFrame, threshold: float, step: float = 1.05) -> DataFrame:
    """(node, bucket, leads): where each of sets (node, s) meets all that can be similar to it; a bucket stands for a shingle and a class of sizes, a factor `step` wide.

    Sets x and y, x the smaller, share at least c = t/(1+t) (|x| + |y|) shingles, so in one
    order, the rarest first, one of them stands before place |x| - c of x and |y| - c of
    y. x leads with its shingles before place |x| - 2t/(1+t) |x|, under its own size; y
    comes by a shingle at place p under all sizes that leave it enough behind p.
    """
    each = sets.select("node", F.explode("s").alias("g"))
    counted = each.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    order = each.join(counted, "g").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("o")).withColumn("size", F.size("o"))
    share, e = threshold / (1 + threshold), 1e-9
    placed = order.select("node", "size", F.posexplode(F.slice("o", 1, F.floor(F.col("size") * (1 - threshold) + e).cast("int") + 1)).alias("p", "x")).filter("x.df > 1")
    class_of = lambda size: F.floor(F.log(size) / F.log(F.lit(step)))
    least, most = F.greatest(F.lit(1.0), F.col("size") * threshold - e), F.least(F.col("size").cast("double"), (F.col("size") - F.col("p")) / share - F.col("size") + e)
    comes = F.when(most >= least, F.transform(F.sequence(class_of(least), class_of(most)), lambda c: F.struct(c.alias("class"), F.lit(False).alias("leads")))).otherwise(F.array().cast("array<struct<class:bigint,leads:boolean>>"))
    leads = F.when(F.col("p") <= F.col("size") * (1 - 2 * share) + e, F.array(F.struct(class_of(F.col("size").cast("double")).alias("class"), F.lit(True).alias("leads")))).otherwise(F.array().cast("array<struct<class:bigint,leads:boolean>>"))
    met = placed.select("node", "x.g", F.explode(F.concat(comes, leads)).alias("c"))
    return met.groupBy("node", F.xxhash64("g", "c.class").alias("bucket")).agg(F.max("c.leads").alias("leads"))


def similar_rows(docs: DataFrame, id_col: str, text_col: str, k: int, threshold: float, prints: int, few: int, seed: int) -> DataFrame:
    """_grouped() by links of the similarity."""
    rows = cut(word_prints(docs, id_col, text_col, k, prints, seed))
    nodes = cut(rows.groupBy("node").agg(F.min(F.struct("id", "raw")).alias("pick"), F.first("prints").alias("prints"), F.first("brief").alias("brief")))
    return _grouped(rows.select("id", "raw", "node"), similar_links(docs, nodes, id_col, text_col, k, threshold, prints, few, seed))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, prints: int = 12, few: int = 8, seed: int = 42) -> DataFrame:
    """(id_col, component_id): the group of each row; component_id is the smallest id reachable over pairs whose k-word shingles have the similarity.

    SimHash finds the pairs, the shingle sets decide. A pair is missed if it agrees in
    no table of any of `prints` fingerprints, and one of the two has more than BRIEF words.
    """
    return similar_rows(docs, id_col, text_col, k, threshold, prints, few, seed).select(F.col("id").alias(id_col), "component_id")


# ------------------------------------------------------------ one of each group


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = 0.8, k: int | None = None, radius: int = 2, prints: int = 12, few: int = 8, seed: int = 42) -> DataFrame:
    """The rows of docs that stand for their groups, one of each: smallest id (nulls last), then smallest hash of the text.

    Groups by similarity of k-word shingles (k is 5 if not given); without a threshold,
    by fingerprints of k-word shingles (3) within the radius. Rows that agree in id and
    text are one row.
    """
    if threshold is None:
        found = _near_rows(docs, id_col, text_col, k or 3, radius, seed)
    else:
        found = similar_rows(docs, id_col, text_col, k or 5, threshold, prints, few, seed)
    stands = F.col("id").eqNullSafe(F.col("pick.id")) & (F.col("raw") == F.col("pick.raw"))
    name, raw, n, text = unused(docs, "__id", "__raw", "__n", "__text")
    keys = cut(found.filter(stands).groupBy("id", "raw").agg(F.count(F.lit(1)).alias(n)).select(F.col("id").alias(name), F.col("raw").alias(raw), n))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    same = docs[id_col].eqNullSafe(F.col(name)) & (F.xxhash64(utf8(docs[text_col])) == F.col(raw))
    kept = docs.join(keys.filter(F.col(n) == 1), same, "left_semi")
    several = keys.filter(F.col(n) > 1)
    if several.isEmpty():
        return kept
    repeated = docs.withColumn(text, F.xxhash64(utf8(docs[text_col]))).join(several, F.col(f"`{id_col}`").eqNullSafe(F.col(name)) & (F.col(text) == F.col(raw)), "left_semi")
    return kept.union(repeated.dropDuplicates([id_col, text]).select(*columns))
