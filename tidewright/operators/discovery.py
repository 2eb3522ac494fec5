"""Keys and references that nobody declared: minimal unique column sets, and columns whose values another table's key holds."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.registry import query
from ..sources.tables import TABLES, cut, table
from .audit import AUDITED, key_candidate

#: Relative error of a distinct-count sketch; a set of columns is given up when its sketch is six errors short of the rows.
ERROR = 0.02
#: The sketches have two to this power registers, which makes their error 1.7 %.
LOG_SIZE = 12
#: One in so many values of a set of columns is looked at for repeats before all are counted.
PARTS = 64
#: Columns that one whole number has bits for.
BITS = 62
KEYS = "table_name string, key string, n_columns int"


def family(kind: T.DataType) -> str | None:
    """Types whose values can be compared as keys: whole numbers, texts, days and times; others are no keys."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "number"
    if isinstance(kind, T.StringType):
        return "text"
    return "time" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else None


def candidate_keys(df: DataFrame, most: int = 2) -> list[tuple[str, ...]]:
    """The minimal sets of up to `most` columns without nulls that tell all rows apart.

    Level by level: one pass sketches the distinct counts of all sets of a size that no
    smaller key is in; a set is left out if its columns' counts can't multiply to the rows.
    What the sketches leave is verified by exact counts, unless a part of its values repeats.
    """
    own = [f.name for f in df.schema if family(f.dataType)]
    sketch = lambda names: F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*[F.col(f"`{n}`") for n in names]), F.lit(LOG_SIZE)))
    first = df.agg(F.count(F.lit(1)), *[x for n in own for x in (sketch((n,)), F.count(f"`{n}`"))]).first()
    n_rows, distinct, keys = first[0], {}, []
    for i, n in enumerate(own):
        if first[2 + 2 * i] == n_rows:  # no nulls
            distinct[n] = first[1 + 2 * i]
    if not n_rows:
        return []
    for size in range(1, most + 1):
        sets = [s for s in combinations(distinct, size) if not any(set(k) <= set(s) for k in keys)]
        if size == 1:
            counts = {s: distinct[s[0]] for s in sets}
        else:
            # the sketches err by 2 % or so: a factor of two a column is far beyond
            sets = [s for s in sets if reduce(lambda a, b: a * b, (2 * distinct[c] for c in s)) >= n_rows]
            counts = dict(zip(sets, df.agg(*[sketch(s) for s in sets]).first(), strict=True)) if sets else {}
        left = [s for s, n in counts.items() if n >= n_rows * (1 - 6 * ERROR)]
        repeats = repeated(df, left)
        keys += [s for s in left if s not in repeats and key_candidate(df.select(*[f"`{c}`" for c in s]), list(s)).first().is_key]
    return keys


def repeated(df: DataFrame, sets: list[tuple[str, ...]]) -> set[tuple[str, ...]]:
    """Those of the sets of columns that are seen to be no keys: a value among one in PARTS of theirs is there twice. All rows of such a value are looked at, so a set that is named here is none for certain."""
    found = []
    for i, s in enumerate(sets):
        own = [F.col(f"`{c}`") for c in s]
        few = df.select(*own).filter(F.pmod(F.xxhash64(*own), F.lit(PARTS)) == 0)
        found.append(few.groupBy(*own).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").limit(1).select(F.lit(i).alias("i")))
    return {sets[r.i] for r in reduce(DataFrame.unionAll, found).collect()} if found else set()


def discover_keys(tables: dict[str, DataFrame], most: int = 2) -> DataFrame:
    """KEYS: the candidate keys of each table; key: its columns, sorted, comma-joined."""
    rows = [(t, ",".join(sorted(k)), len(k)) for t, df in sorted(tables.items()) for k in candidate_keys(df, most)]
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, KEYS)


def inclusions(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, ref_table, ref_column): each column all of whose values another column of its family has, and that one is a key. Columns without values are in none.

    All cells are met by value once: a value's columns are the bits of a few whole numbers,
    which each task joins before it sends them on, and equal sets of columns are counted
    together, so what the pairs are made of are sets, not values.
    """
    spark = next(iter(tables.values())).sparkSession
    columns = [(t, f.name, family(f.dataType)) for t, df in sorted(tables.items()) for f in df.schema if family(f.dataType)]
    keyed = {(t, k[0]) for t, df in tables.items() for k in candidate_keys(df, 1)}
    place = {c[:2]: i for i, c in enumerate(columns)}
    words = [f"w{i}" for i in range(-(-len(columns) // BITS))]
    each = []
    for t, df in sorted(tables.items()):
        own = [f for f in df.schema if family(f.dataType)]
        if own:
            wide = lambda f: F.col(f"`{f.name}`").cast({"number": "long", "time": "timestamp_ntz"}.get(family(f.dataType), "string"))
            # values of two families are never the same
            value = lambda f: [F.when(F.col(f"`{f.name}`").isNotNull(), F.xxhash64(F.lit(f"{n}{family(f.dataType)}"), wide(f))).alias(n) for n in "ab"]
            bit = lambda f: [F.lit(1 << place[t, f.name] % BITS if place[t, f.name] // BITS == i else 0).cast("long").alias(w) for i, w in enumerate(words)]
            each.append(df.select(F.explode(F.array(*[F.struct(*value(f), *bit(f)) for f in own])).alias("x")).select("x.*").filter("a is not null"))
    values = reduce(DataFrame.unionByName, each).groupBy("a", "b").agg(*[F.bit_or(w).alias(w) for w in words])
    sets = cut(values.groupBy(*words).agg(F.count(F.lit(1)).alias("n")))
    held = F.array(*[F.when(F.col(words[c // BITS]).bitwiseAND(F.lit(1 << c % BITS)) != 0, F.lit(c)) for c in range(len(columns))])
    sets = sets.select("n", F.array_compact(held).alias("s"))
    pairs = sets.select("n", "s", F.explode("s").alias("c")).select("n", "c", F.explode("s").alias("d"))
    held = pairs.groupBy("c", "d").agg(F.sum("n").alias("n"))
    whole = held.filter("c = d").select("c", F.col("n").alias("total"))
    found = held.filter("c != d").join(whole, "c").filter("n = total").select("c", "d").collect()  # pairs of columns
    rows = [(*columns[r.c][:2], *columns[r.d][:2]) for r in found if columns[r.d][:2] in keyed]
    return spark.createDataFrame(rows, "table_name string, column_name string, ref_table string, ref_column string")


#: Columns of the given tables that are no keys by their type.
NO_KEYS = ("s_acctbal", "c_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "value", "embedding")
TIMES = ("o_orderdate", "l_shipdate", "ts")
_OWN = {t: [(c.strip("*"), "text" if c.endswith("*") else "time" if c in TIMES else "number") for c in columns.split() if c.strip("*") not in NO_KEYS] for t, columns in AUDITED.items()}


def _keys_sql() -> str:
    ones = [f"SELECT '{t}' AS t, '{c}' AS a, CAST(NULL AS VARCHAR) AS b, count(DISTINCT {c}) = count(*) AND count({c}) = count(*) AS u FROM {t}" for t, own in _OWN.items() for c, _ in own]
    twos = [f"SELECT '{t}' AS t, '{a}' AS a, '{b}' AS b, count(DISTINCT ({a}, {b})) = count(*) AND count({a}) = count(*) AND count({b}) = count(*) AS u FROM {t}" for t, own in _OWN.items() for a, b in combinations(sorted(c for c, _ in own), 2)]
    return f"""WITH one AS ({" UNION ALL ".join(ones)}), two AS ({" UNION ALL ".join(twos)})
SELECT t AS table_name, a AS key, 1 AS n_columns FROM one WHERE u UNION ALL
SELECT t, a || ',' || b, 2 FROM two WHERE u AND NOT EXISTS (SELECT 1 FROM one WHERE one.u AND one.t = two.t AND (one.a = two.a OR one.a = two.b))"""


@query(_keys_sql())
def discovered_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimal keys of one and two columns of all tables."""
    return discover_keys({t: table(spark, sf_dir, t) for t in TABLES})


def _references_sql() -> str:
    columns = [(t, c, k) for t, own in _OWN.items() for c, k in own]
    values = " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, '{k}' AS f, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL" for t, c, k in columns)
    keys = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, count(DISTINCT {c}) = count(*) AS u FROM {t}" for t, c, _ in columns)
    return f"""WITH v AS ({values}), n AS (SELECT t, c, count(*) AS n FROM v GROUP BY 1, 2), k AS (SELECT t, c FROM ({keys}) WHERE u),
r AS (SELECT v.* FROM v JOIN k USING (t, c)), m AS (SELECT v.t, v.c, r.t AS rt, r.c AS rc, count(*) AS n FROM v JOIN r ON v.f = r.f AND v.v = r.v AND (v.t <> r.t OR v.c <> r.c) GROUP BY 1, 2, 3, 4)
SELECT m.t AS table_name, m.c AS column_name, rt AS ref_table, rc AS ref_column FROM m JOIN n ON n.t = m.t AND n.c = m.c AND n.n = m.n"""


@query(_references_sql())
def discovered_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of all tables whose values are all in a key of another one, or of their own."""
    return inclusions({t: table(spark, sf_dir, t) for t in TABLES})
