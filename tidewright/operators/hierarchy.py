"""Hierarchies walked level by level: bills of material, managers, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import path_parent
from ..plans.registry import query
from ..sources.tables import cut, table


def walk(start: DataFrame, edges: DataFrame, on: tuple[str, str], most: int = 25) -> DataFrame:
    """Rows reached from `start` (columns node, origin) along edges, with their level.

    on: the columns of edges to come from and to go to. Each level is one join, written
    to the shared folder; more than `most` levels raise an error, as a cycle would.
    """
    source, target = on
    frontier = cut(start.select("origin", "node", F.lit(0).alias("level")))
    out, level = frontier, 0
    steps = edges.select(F.col(source).alias("node"), F.col(target).alias("__to"))
    while True:
        level += 1
        frontier = cut(frontier.join(steps, "node").select("origin", F.col("__to").alias("node"), F.lit(level).alias("level")))
        if frontier.isEmpty():
            return out
        if level > most:
            raise RecursionError(f"more than {most} levels")
        out = out.unionByName(frontier)


def roots(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, root, depth, cyclic): the root that each node hangs on and the steps up to it, by path doubling: rounds go with the logarithm of the depth.

    Each round a node's pointer is put where the pointer of its place points. A node without
    a parent is a root of depth 0; of several parents of a node the smallest counts. Nodes
    that no number of steps takes to a root, in a cycle or below one, have no root and no
    depth: cyclic. Null nodes are left out.
    """
    up = edges.filter(F.col(child).isNotNull() & F.col(parent).isNotNull()).groupBy(F.col(child).alias("node")).agg(F.min(parent).alias("at"))
    # the joins are merges: files of nodes are small for their rows, and Spark would send them all through the driver in each round
    top = up.select(F.col("at").alias("node")).distinct().join(up.hint("merge"), "node", "left_anti").select("node", F.col("node").alias("at"), F.lit(0).cast("long").alias("depth"), F.lit(True).alias("done"))
    state = cut(up.select("node", "at", F.lit(1).cast("long").alias("depth"), F.lit(False).alias("done")).union(top))
    nodes, steps = state.count(), 1
    while steps < 2 * nodes:
        held, open_ = state.filter("done"), state.filter("not done")
        place = state.select(F.col("node").alias("at"), F.col("at").alias("__at"), F.col("depth").alias("__depth"), F.col("done").alias("__done"))
        moved = open_.join(place.hint("merge"), "at").select("node", F.col("__at").alias("at"), (F.col("depth") + F.col("__depth")).alias("depth"), F.col("__done").alias("done"))
        state = cut(held.union(moved))
        if state.filter("not done").isEmpty():
            break
        steps *= 2
    ends = lambda c: F.when(F.col("done"), F.col(c))
    return state.select("node", ends("at").alias("root"), ends("depth").alias("depth"), (~F.col("done")).alias("cyclic"))


@query("""WITH m AS (SELECT min(p_partkey) AS low, max(p_partkey) AS high FROM part)
SELECT p_partkey AS node, CASE WHEN p_partkey <= high - 10 THEN low END AS root, CASE WHEN p_partkey <= high - 10 THEN p_partkey - low END AS depth, p_partkey > high - 10 AS cyclic FROM part, m""")
def deep_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of all parts but the last ten, each below the one before it; those ten are a cycle."""
    part = table(spark, sf_dir, "part").select("p_partkey")
    low, high = part.agg(F.min("p_partkey"), F.max("p_partkey")).first()
    parent = F.when(F.col("p_partkey") == high - 9, high).when(F.col("p_partkey") > low, F.col("p_partkey") - 1)
    return roots(part.select("p_partkey", parent.alias("parent")), "p_partkey", "parent")


def bill_of_materials(edges: DataFrame, start: int | list[int], at: Column | None = None, names: tuple[str, ...] = ("assembly", "component", "quantity", "from", "to"), up: bool = False, most: int = 25) -> DataFrame:
    """(origin, node, level, quantity): what the assemblies in `start` are made of, level by level, or with `up` what they are used in.

    at: the day that edges must hold on, from and to included, an open end without end. The
    quantity of a component is summed over the ways of a level. In order of level and node.
    """
    assembly, component, quantity, begins, ends = names
    if at is not None:
        edges = edges.filter((F.col(begins) <= at) & (F.col(ends).isNull() | (F.col(ends) >= at)))
    source, target = (component, assembly) if up else (assembly, component)
    ids = [start] if isinstance(start, int) else start
    first = edges.sparkSession.createDataFrame([(i,) for i in ids], "node long")
    frontier = cut(first.select(F.col("node").alias("origin"), "node", F.lit(0).alias("level"), F.lit(1).cast("decimal(38,4)").alias("quantity")))
    steps, out = edges.select(F.col(source).alias("node"), F.col(target).alias("__to"), F.col(quantity).cast("decimal(18,4)").alias("__q")), None
    for level in range(1, most + 2):
        made = frontier.join(steps, "node").groupBy("origin", F.col("__to").alias("node")).agg(F.sum((F.col("quantity") * F.col("__q")).cast("decimal(38,4)")).cast("decimal(38,4)").alias("quantity"))
        frontier = cut(made.select("origin", "node", F.lit(level).alias("level"), "quantity"))
        if frontier.isEmpty():
            break
        if level > most:
            raise RecursionError(f"more than {most} levels")
        out = frontier if out is None else out.unionByName(frontier)
    return (frontier if out is None else out).orderBy("origin", "level", "node")


PARTS_SQL = "(SELECT p_partkey // 2 AS assembly, p_partkey AS component, 1 + p_size % 3 AS quantity FROM part WHERE p_partkey > 1 AND p_size % 10 <> 0)"


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part belongs to the part of half its number; those of some sizes only until a day before."""
    part = table(spark, sf_dir, "part").filter("p_partkey > 1")
    day = lambda d: F.lit(d).cast("date")
    return part.select(F.floor(F.col("p_partkey") / 2).alias("assembly"), F.col("p_partkey").alias("component"), (1 + F.col("p_size") % 3).alias("quantity"), day("2020-01-01").alias("from"), F.when(F.col("p_size") % 10 == 0, day("2020-05-31")).alias("to"))


@query(f"""WITH RECURSIVE e AS {PARTS_SQL}, t(origin, node, level, quantity) AS (SELECT component, component, 0, CAST(1 AS DECIMAL(38,4)) FROM (VALUES (CAST(2 AS BIGINT)), (5)) AS s(component)
UNION ALL SELECT origin, component, level + 1, CAST(t.quantity * e.quantity AS DECIMAL(38,4)) FROM t JOIN e ON assembly = node)
SELECT origin, node, level, sum(quantity)::DECIMAL(38,4) AS quantity FROM t WHERE level > 0 GROUP BY 1, 2, 3""")
def parts_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two assemblies are made of on a day, with quantities."""
    return bill_of_materials(_assembled(spark, sf_dir), [2, 5], F.lit("2021-01-01").cast("date"))


@query(f"""WITH RECURSIVE e AS {PARTS_SQL}, t(origin, node, level, quantity) AS (SELECT p_partkey, p_partkey, 0, CAST(1 AS DECIMAL(38,4)) FROM part WHERE p_partkey IN (100, 101, 177)
UNION ALL SELECT origin, assembly, level + 1, CAST(t.quantity * e.quantity AS DECIMAL(38,4)) FROM t JOIN e ON component = node)
SELECT origin, node, level, sum(quantity)::DECIMAL(38,4) AS quantity FROM t WHERE level > 0 GROUP BY 1, 2, 3""")
def parts_where_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three parts are used in on a day."""
    return bill_of_materials(_assembled(spark, sf_dir), [100, 101, 177], F.lit("2021-01-01").cast("date"), up=True)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part but the first belongs to the part of half its number."""
    return table(spark, sf_dir, "part").filter("p_partkey > 0").select(F.floor(F.col("p_partkey") / 2).alias("parent"), F.col("p_partkey").alias("child"), F.col("p_retailprice").cast("decimal(18,2)").alias("cost"))


@query("""WITH RECURSIVE t(node, level) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT p_partkey, level + 1 FROM t JOIN part ON p_partkey // 2 = node AND p_partkey > 1)
SELECT level, count(*) AS n_parts, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DECIMAL(38,4)) AS cost FROM t JOIN part ON node = p_partkey GROUP BY 1""")
def recursive_bom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and their cost by level below part 1."""
    part = table(spark, sf_dir, "part")
    start = part.filter("p_partkey = 1").select(F.col("p_partkey").alias("origin"), F.col("p_partkey").alias("node"))
    levels = walk(start, _edges(spark, sf_dir).filter("child > 1"), ("parent", "child"))
    cost = part.select(F.col("p_partkey").alias("node"), F.col("p_retailprice").cast("decimal(18,2)").alias("c"))
    return levels.join(cost, "node").groupBy("level").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("c").cast("decimal(38,4)").alias("cost"))


@query("""WITH RECURSIVE t(origin, node, level) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_brand = 'Brand#2' UNION ALL SELECT origin, node // 2, level + 1 FROM t WHERE node > 1)
SELECT origin, max(level) AS depth, string_agg(node, '/' ORDER BY level DESC) AS path, CASE WHEN max(level) = 0 THEN NULL ELSE string_agg(node, '/' ORDER BY level DESC) FILTER (WHERE level > 0) END AS parent FROM t GROUP BY 1""")
def recursive_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way up from each part of a brand, as a path; the parent's path is the path without its last step."""
    start = table(spark, sf_dir, "part").filter("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("origin"), F.col("p_partkey").alias("node"))
    up = walk(start, _edges(spark, sf_dir).filter("child > 1"), ("child", "parent"))
    steps = F.array_sort(F.collect_list(F.struct((-F.col("level")).alias("up"), F.col("node").cast("string").alias("node"))))
    paths = up.groupBy("origin").agg(F.max("level").alias("depth"), F.array_join(F.transform(steps, lambda x: x["node"]), "/").alias("path"))
    parent = F.regexp_replace(path_parent(F.concat(F.lit("/"), "path", F.lit("/"))), "^/|/$", "")
    return paths.select("origin", "depth", "path", F.when(F.col("depth") > 0, parent).alias("parent"))
