"""Change data: folding, applying and counting changes; differences of metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.registry import query
from ..sources.tables import TABLES, cut, table

#: Operations by the code of a log-based changelog: fixed values.
LOG_OPERATIONS = {1: "DELETE", 2: "INSERT", 3: "UPDATE", 4: "UPDATE"}
#: Names that a change time may have, in order of preference: fixed values.
TIME_NAMES = (
    "modifieddate", "modified_date", "updated_at", "updatedat",
    "last_modified", "lastmodified", "modified", "updated",
    "timestamp", "change_date", "changedate",
)

#: Names that a key column may have, in order of preference: fixed values.
KEY_NAMES = ("id", "businessentityid", "productid", "salesorderid", "customerid")
#: Operations by the name that a document server's change stream has for them: fixed values; others are no row changes.
STREAM_OPERATIONS = {"insert": "INSERT", "update": "UPDATE", "replace": "UPDATE", "delete": "DELETE"}


def key_columns(schema: T.StructType, declared: tuple[str, ...] = ()) -> list[str]:
    """The columns that tell rows apart: the declared key, else the first known name, in any case of letters."""
    named = {f.name.lower(): f.name for f in schema}
    if declared:
        return [named[d.lower()] for d in declared]
    if found := next((named[n] for n in KEY_NAMES if n in named), None):
        return [found]
    raise ValueError("no key is declared, and no column has a key's name")


def told(events: DataFrame, column: str, fields: str) -> DataFrame:
    """(seq, op, table_name, key, data, raw, problem): all events of a change stream, read from JSON.

    problem: why one can't be applied. An update without its document names only what
    changed, so it can't stand for the row. Drops, creates and the like have no op and
    no problem.
    """
    kind = f"_id struct<_data:string>, operationType string, ns struct<coll:string>, documentKey struct<_id:string>, fullDocument struct<{fields}>"
    # made a row of its own, an event is parsed once; filters on it would else parse it again for each field
    read = events.select(F.col(column).alias("raw"), F.explode(F.array(F.from_json(column, kind))).alias("e"))
    op = F.element_at(F.create_map(*[F.lit(x) for kv in STREAM_OPERATIONS.items() for x in kv]), F.col("e.operationType"))
    rows = read.select(F.col("e._id._data").alias("seq"), op.alias("op"), F.col("e.ns.coll").alias("table_name"), F.col("e.documentKey._id").alias("key"), F.when(op != "DELETE", F.col("e.fullDocument")).alias("data"), "raw", F.col("e.operationType").alias("__kind"))
    problem = (
        F.when(F.try_parse_json("raw").isNull() | F.col("__kind").isNull(), "the event can't be read")
        .when(F.col("op").isNotNull() & F.col("seq").isNull(), "no position")
        .when((F.col("op") != "DELETE") & F.col("data").isNull(), "no document")
        .when((F.col("op") == "DELETE") & F.col("key").isNull(), "no key")
    )
    return rows.withColumn("problem", problem).drop("__kind")


def document_changes(events: DataFrame, column: str, fields: str, after: str | None = None) -> DataFrame:
    """(seq, op, table_name, key, data): row changes from JSON events of a change stream, those up to the token `after` left out.

    fields: DDL of the documents' fields. A replaced document is an update; a delete
    has a key and no data; drops, creates and events with a problem are no row changes.
    """
    rows = told(events, column, fields).filter("op is not null and problem is null").drop("raw", "problem")
    return rows if after is None else rows.filter(F.col("seq") > after)


def log_changes(log: DataFrame, after: bytes | None = None) -> DataFrame:
    """Rows of a log-based changelog as changes: op and seq in place of the meta columns; positions up to `after` are done already."""
    if after is not None:
        log = log.filter(F.col("`__$start_lsn`") > F.lit(after))
    op = F.element_at(F.create_map(*[F.lit(x) for kv in LOG_OPERATIONS.items() for x in kv]), F.col("`__$operation`"))
    # of an update's two images only the one after counts
    rows = log.filter("`__$operation` != 3").select("*", op.alias("op"), log_position().alias("seq"))
    return rows.drop(*[c for c in rows.columns if c.startswith("__$")])


def log_position() -> Column:
    """A log's position as text: hexadecimal, so that texts sort as the bytes do."""
    return F.concat(F.hex("`__$start_lsn`"), F.hex("`__$seqval`"))


def log_bytes(position: str) -> bytes:
    """The bytes that a position's text stands for."""
    return bytes.fromhex(position)


def change_time(schema: T.StructType) -> str | None:
    """The column that tells when a row changed: a known name, else the first date or time; None: the table can't be polled."""
    times = [f.name for f in schema if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    known = {n.lower(): n for n in times}
    return next((known[n] for n in TIME_NAMES if n in known), times[0] if times else None)


def has_map(kind: T.DataType) -> bool:
    """Whether values of the type have no order."""
    if isinstance(kind, T.ArrayType):
        return has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(has_map(f.dataType) for f in kind)
    return isinstance(kind, (T.MapType, T.VariantType))


def latest(changes: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """The last change of each key; of several at one position the largest. An aggregate rather than a window: each task sends on one row a key, so a hot key costs no large partition."""
    rest = [c for c in changes.columns if c not in (*key, *seq)]
    whole = F.struct(*seq, *[F.col(f"`{c}`") for c in rest])
    if any(has_map(changes.schema[c].dataType) for c in rest):
        # maps have no order: their JSON text has
        text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest]))
        best = changes.groupBy(*key).agg(F.max_by(whole, F.struct(*seq, text.alias("__text"))).alias("c"))
    else:
        best = changes.groupBy(*key).agg(F.max(whole).alias("c"))
    return best.select(*key, *[F.col(f"c.`{c}`").alias(c) for c in (*seq, *rest)])


def apply_changes(target: DataFrame, changes: DataFrame, key: list[str], seq: list[str], op: str = "op") -> DataFrame:
    """The target after all changes: of each key the last one counts; a delete removes, anything else puts the row. A null key is a key like any other. Applying twice changes nothing."""
    last = latest(changes, key, seq)
    put = last.filter(F.col(op) != "DELETE").select(*target.columns)
    named = last.select(*[F.col(f"`{k}`").alias(f"__{k}") for k in key])
    same = reduce(Column.__and__, [F.col(f"`{k}`").eqNullSafe(F.col(f"`__{k}`")) for k in key])
    return target.join(named, same, "left_anti").select(*target.columns).unionByName(put)


def with_audit(changes: DataFrame, at: str, op: str = "op") -> DataFrame:
    """Changes as an append-only history: the data columns with _cdc_timestamp and _cdc_operation in place of their own time and operation. Nothing is folded: a repeated change is a row of its own."""
    return changes.select(*[F.col(f"`{c}`") for c in changes.columns if c not in (at, op)], F.col(at).alias("_cdc_timestamp"), F.col(op).alias("_cdc_operation"))


def row_filter(before: str | Column, after: str | Column) -> Column:
    """What tells a changed row apart, as a map of lower-case names to values: from the image before the change, or else the one after (maps of texts).

    The first known key name with a value; without one, the first two fields that have
    a value; an empty map if there is none: such a change can only be appended.
    """
    image = F.coalesce(*[F.when(F.size(x) > 0, x) for x in (F.col(before) if isinstance(before, str) else before, F.col(after) if isinstance(after, str) else after)])
    held = F.transform(F.filter(F.map_entries(image), lambda e: e["value"].isNotNull()), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    # what is used more than once is the one element of a list that is gone through: Spark would compute it anew for each use
    once = lambda column, use: F.transform(F.array(column), use)[0]
    rank = lambda e, i: F.struct(F.array_position(F.array(*[F.lit(n) for n in KEY_NAMES]), e["key"]).alias("rank"), i.alias("i"), e["key"].alias("key"), e["value"].alias("value"))
    best = lambda h: F.array_min(F.filter(F.transform(h, rank), lambda e: e["rank"] > 0))
    found = once(held, lambda h: once(best(h), lambda b: F.when(b.isNotNull(), F.array(F.struct(b["key"].alias("key"), b["value"].alias("value")))).otherwise(F.slice(h, 1, 2))))
    return F.coalesce(F.map_from_entries(found), F.create_map().cast("map<string,string>"))


def apply_by_filter(target: DataFrame, changes: DataFrame, seq: list[str]) -> DataFrame:
    """The target after changes that find their row by a filter (row_filter()) in place of a key.

    changes: op, filter (map of column names to values as text), data (a struct of the
    target's columns), and seq. An insert adds a row. Of the updates and deletes of one filter
    the last counts: an update takes the place of one row that agrees, or adds one if none
    does; a delete takes one row away. Without a filter an update adds a row, and a delete
    does nothing. Filters over different columns are applied one after the other.
    """
    columns, named = [F.col(f"`{c}`") for c in target.columns], {c.lower(): c for c in target.columns}
    # each set of columns reads the changes: what a filter costs, it costs once
    changes = cut(changes.select("op", "filter", "data", *[F.col(f"`{s}`") for s in seq]))
    added = changes.filter((F.col("op") == "INSERT") | ((F.size("filter") == 0) & (F.col("op") != "DELETE"))).select("data.*")
    found = changes.filter((F.col("op") != "INSERT") & (F.size("filter") > 0)).withColumn("names", F.array_sort(F.map_keys("filter")))
    # one row for each set of columns that filters name
    sets = [r.names for r in found.select("names").distinct().collect() if set(r.names) <= named.keys()]
    for names in sorted(sets):
        values = [f"__f{n}" for n in range(len(names))]
        part = found.filter(F.col("names") == F.array(*[F.lit(n) for n in names])).select(*[F.col("filter")[n].alias(v) for n, v in zip(names, values, strict=True)], *seq, "op", "data")
        last = latest(part, values, seq).select(*values, "op", "data")
        order = Window.partitionBy(*[F.col(f"`{named[n]}`") for n in names]).orderBy(F.xxhash64(F.to_json(F.struct(*columns))))
        numbered = target.withColumn("__nth", F.row_number().over(order))
        same = reduce(Column.__and__, [F.col(f"`{named[n]}`").cast("string") == F.col(v) for n, v in zip(names, values, strict=True)]) & (F.col("__nth") == 1)
        kept = numbered.join(last.select(*values), same, "left_anti").select(*columns)
        target = cut(kept.unionByName(last.filter("op != 'DELETE'").select("data.*")))
    return target.unionByName(added)


def trigger_told(log: DataFrame, fields: str) -> DataFrame:
    """(seq, op, schema_name, table_name, data, changed_at, raw, problem): all rows of the log that triggers fill (id, schema_name, table_name, operation, row_data, changed_at)."""
    payload = F.try_parse_json("row_data")
    first = F.coalesce(F.try_variant_get(payload, "$[0]", "variant"), F.when(F.schema_of_variant(payload).startswith("OBJECT"), payload))
    data = F.from_json(F.to_json(first), f"struct<{fields}>")
    rows = log.select(F.col("id").alias("seq"), F.col("operation").alias("op"), "schema_name", "table_name", data.alias("data"), "changed_at", F.col("row_data").alias("raw"))
    problem = F.when(F.col("seq").isNull(), "no position").when(F.coalesce(~F.col("op").isin("INSERT", "UPDATE", "DELETE"), F.lit(True)), "unknown operation").when(F.col("data").isNull(), "the payload can't be read")
    return rows.withColumn("problem", problem)


def trigger_changes(log: DataFrame, fields: str, after: int = 0) -> DataFrame:
    """(seq, op, schema_name, table_name, data, changed_at): row changes from the log that triggers fill, those up to the id `after` left out.

    row_data: the row as JSON, or a list of rows, of which the first counts. fields: DDL
    of the data. Empty and broken payloads give null data.
    """
    return trigger_told(log.filter(F.col("id") > after), fields).drop("raw", "problem")


def source_kind(columns: list[str]) -> str:
    """How a source tells its changes, by the columns that it has: log, trigger, stream or poll."""
    names = {c.lower() for c in columns}
    if {"__$start_lsn", "__$operation"} <= names:
        return "log"
    if {"id", "operation", "row_data"} <= names:
        return "trigger"
    return "stream" if "event" in names else "poll"


def later(at: str, key: str, after: tuple) -> Column:
    """Rows behind a position (time, key): those of its time come in the order of the key. The plain bound is what a scan can skip files by."""
    time, last = after
    return (F.col(f"`{at}`") >= time) & ((F.col(f"`{at}`") > time) | (F.col(f"`{key}`") > last))


def captured(source: DataFrame, fields: str = "", after: str | int | bytes | tuple | None = None, key: str | None = None) -> DataFrame:
    """The changes of a source of any kind, from its checkpoint `after` on. A polled table has inserts only, ordered by its change time, and by its key where one is named: its checkpoint is then (time, key)."""
    kind = source_kind(source.columns)
    if kind == "log":
        return log_changes(source, after)
    if kind == "trigger":
        return trigger_changes(source, fields, after or 0)
    if kind == "stream":
        return document_changes(source, "event", fields, after)
    at = change_time(source.schema)
    if at is None:
        raise ValueError("no column tells when a row changed")
    rows = source
    if after is not None:
        when = F.lit(after[0] if key else after).cast(source.schema[at].dataType)
        rows = source.filter(later(at, key, (when, F.lit(after[1]).cast(source.schema[key].dataType))) if key else F.col(f"`{at}`") > when)
    seq = F.struct(F.col(f"`{at}`").alias("at"), F.col(f"`{key}`").alias("key")) if key else F.col(f"`{at}`")
    return rows.select("*", F.lit("INSERT").alias("op"), seq.alias("seq"))


def operation(event_type: Column) -> Column:
    return F.when(event_type == "error", "DELETE").when(event_type == "signup", "INSERT").otherwise("UPDATE")


OP_SQL = "CASE event_type WHEN 'error' THEN 'DELETE' WHEN 'signup' THEN 'INSERT' ELSE 'UPDATE' END"
FOLD_SQL = f"SELECT user_id, event_id, ts, value FROM (SELECT *, {OP_SQL} AS op, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND op <> 'DELETE'"


def fold_events(events: DataFrame) -> DataFrame:
    changes = events.select("user_id", "ts", "event_id", "value", operation(F.col("event_type")).alias("op"))
    return latest(changes, ["user_id"], ["ts", "event_id"]).filter("op != 'DELETE'").select("user_id", "event_id", "ts", "value")


@query(FOLD_SQL)
def cdc_fold_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_events(table(spark, sf_dir, "events"))


@query(f"""WITH last AS (SELECT * FROM (SELECT user_id, value, {OP_SQL} AS op, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1)
SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM last) UNION ALL SELECT user_id, value FROM last WHERE op <> 'DELETE'""")
def cdc_apply_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balances after the events: the last value of each user, none after a delete."""
    changes = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), F.col("value").alias("c_acctbal"), "ts", "event_id", operation(F.col("event_type")).alias("op"))
    return apply_changes(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), changes, ["c_custkey"], ["ts", "event_id"])


@query(f"SELECT {OP_SQL} AS op, count(*) AS n_events, count(DISTINCT user_id) AS n_keys, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def cdc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("op", operation(F.col("event_type")))
    return events.groupBy("op").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("user_id").alias("n_keys"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def new_tables(now: DataFrame, before: DataFrame) -> DataFrame:
    """Audited tables that an earlier audit lacks."""
    return now.join(before, ["schema_name", "table_name"], "left_anti")


@query(" UNION ALL ".join(f"SELECT 'dbo' AS schema_name, '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES[5:]))
def sync_new_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that appeared since the first five were audited, with their rows."""
    from .relational import global_counts

    now = global_counts(spark, sf_dir).select(F.lit("dbo").alias("schema_name"), "table_name", "row_count")
    return new_tables(now, now.filter(F.col("table_name").isin(*TABLES[:5])).select("schema_name", "table_name"))


@query(" UNION ALL ".join(f"SELECT 'dbo' AS schema_name, table_name, column_name, ordinal_position FROM information_schema.columns WHERE table_schema = 'main' AND table_name = '{t}'" for t in TABLES[5:]))
def sync_new_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the tables that appeared since the first five were audited."""
    from .audit import audit_columns

    columns = audit_columns({t: table(spark, sf_dir, t) for t in TABLES})
    found = sync_new_tables(spark, sf_dir).filter("row_count >= 0").select("schema_name", "table_name")
    return columns.join(found, ["schema_name", "table_name"], "left_semi").select("schema_name", "table_name", "column_name", "ordinal_position")


@query("""SELECT event_type, user_id, max(n) AS versions FROM (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS n FROM events) GROUP BY 1, 2""")
def cdc_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many versions each key has had."""
    return table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("versions"))


@query(f"""WITH k AS (SELECT CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS k, event_id, ts, value, {OP_SQL} AS op FROM events),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) AS n FROM k) WHERE n = 1),
t AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey END AS k, c_acctbal AS value FROM customer)
SELECT k, value FROM t WHERE NOT EXISTS (SELECT 1 FROM last WHERE last.k IS NOT DISTINCT FROM t.k) UNION ALL SELECT k, value FROM last WHERE op <> 'DELETE'""")
def cdc_apply_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes applied twice to rows of which some have no key: no row comes again."""
    named = lambda c: F.when(F.col(c) % 10 != 0, F.col(c))
    target = table(spark, sf_dir, "customer").select(named("c_custkey").alias("k"), F.col("c_acctbal").alias("value"))
    made = table(spark, sf_dir, "events").select(named("user_id").alias("k"), "value", "ts", "event_id", operation(F.col("event_type")).alias("op"))
    return apply_changes(apply_changes(target, made, ["k"], ["ts", "event_id"]), made, ["k"], ["ts", "event_id"])


@query(f"SELECT event_id, user_id, value, ts AS _cdc_timestamp, {OP_SQL} AS _cdc_operation FROM events")
def cdc_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "ts", operation(F.col("event_type")).alias("op"))
    return with_audit(events, "ts")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'id=' || user_id WHEN event_id % 3 = 1 THEN 'customerid=' || (user_id + 1) ELSE 'kind=' || event_type || ',value=' || event_id END AS told FROM events""")
def cdc_row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By what a change finds its row: the image before it, a known key name, or the first two fields."""
    pair = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in kv])
    user, number = F.col("user_id"), F.col("event_id")
    before = F.when(number % 3 == 1, pair("Note", F.lit("x"), "CustomerID", user + 1))
    after = F.when(number % 3 == 0, pair("Value", number, "Id", user)).when(number % 3 == 1, pair("Id", user)).otherwise(pair("Nothing", F.lit(None), "Kind", F.col("event_type"), "Value", number, "More", user))
    found = table(spark, sf_dir, "events").select("event_id", F.map_entries(row_filter(before, after)).alias("f"))
    return found.select("event_id", F.array_join(F.transform("f", lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("told"))


@query(f"""SELECT event_id AS seq, {OP_SQL} AS op, event_type AS table_name, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id * 2 END AS twice FROM events WHERE event_id > 100""")
def cdc_trigger_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as triggers log them: rows, lists of rows, and payloads that can't be read."""
    row = F.to_json(F.struct("user_id", (F.col("event_id") * 2).alias("twice")))
    payload = F.when(F.col("event_id") % 7 == 0, F.when(F.col("event_id") % 2 == 0, "{broken")).when(F.col("event_id") % 2 == 0, row).otherwise(F.concat(F.lit("["), row, F.lit(', {"user_id": -1}]')))
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("dbo").alias("schema_name"), F.col("event_type").alias("table_name"), operation(F.col("event_type")).alias("operation"), payload.alias("row_data"), F.col("ts").alias("changed_at"))
    return captured(log, "user_id:long,twice:long", 100).select("seq", "op", "table_name", "data.user_id", "data.twice")


@query(f"""SELECT {OP_SQL} AS op, event_type AS table_name, count(*) AS n, count(DISTINCT user_id) AS n_keys, sum(CASE WHEN event_type <> 'error' THEN event_id END)::BIGINT AS ids FROM events WHERE event_id >= 50 GROUP BY 1, 2""")
def cdc_document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a document server's change stream tells them, read again from a resume token on."""
    name = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "insert").when(F.col("event_id") % 2 == 0, "replace").otherwise("update")
    token = F.lpad(F.col("event_id").cast("string"), 19, "0")
    told = F.struct(F.struct(token.alias("_data")).alias("_id"), name.alias("operationType"), F.struct(F.col("event_type").alias("coll")).alias("ns"), F.struct(F.col("user_id").cast("string").alias("_id")).alias("documentKey"), F.struct("event_id", "value").alias("fullDocument"))
    read = document_changes(table(spark, sf_dir, "events").select(F.to_json(told).alias("event")), "event", "event_id:long,value:double", after=f"{49:019d}")
    return read.groupBy("op", "table_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_keys"), F.sum("data.event_id").alias("ids"))


@query("""SELECT c_custkey, CASE WHEN n > 0 THEN 'ACTIVE' ELSE c_mktsegment END AS c_mktsegment, c_acctbal + coalesce(spent, 0) AS c_acctbal
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, CAST(count(*) AS DOUBLE) AS spent FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) ON o_custkey = c_custkey""")
def update_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update of rows that another table names, as a new table: the rest stays as it is."""
    named = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    joined = table(spark, sf_dir, "customer").join(named, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("c_custkey", F.when(F.col("n") > 0, "ACTIVE").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), (F.col("c_acctbal") + F.coalesce("n", F.lit(0)).cast("double")).alias("c_acctbal"))


@query("""WITH last AS (SELECT * FROM (SELECT user_id, event_id, value, event_type = 'error' AS gone, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type <> 'signup') WHERE n = 1),
t AS (SELECT c_custkey AS id, c_custkey + 1000000 AS customerid, c_acctbal AS value FROM customer)
SELECT id, customerid, value FROM t WHERE NOT EXISTS (SELECT 1 FROM last WHERE user_id = id) UNION ALL SELECT user_id, user_id + 1000000, value FROM last WHERE NOT gone
UNION ALL SELECT -event_id, NULL, value FROM events WHERE event_type = 'signup'""")
def cdc_filtered_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that find their rows by the image before them, some by one column, some by another; inserts are added."""
    events, customer = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer")
    target = customer.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") + 1000000).alias("customerid"), F.col("c_acctbal").alias("value"))
    fresh, user = F.col("event_type") == "signup", F.col("user_id")
    pair = lambda name, v: F.create_map(F.lit(name), v.cast("string"))
    before = F.when(user % 2 == 0, pair("Id", user)).otherwise(pair("CustomerID", user + 1000000))
    data = F.struct(F.when(fresh, -F.col("event_id")).otherwise(user).alias("id"), F.when(~fresh, user + 1000000).alias("customerid"), "value")
    op = F.when(fresh, "INSERT").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    made = events.select(op.alias("op"), row_filter(before, F.create_map().cast("map<string,string>")).alias("filter"), data.alias("data"), "ts", "event_id")
    return apply_by_filter(target, made, ["ts", "event_id"])
