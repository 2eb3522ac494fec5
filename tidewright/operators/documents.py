"""Rows as documents and documents as rows; schemas inferred from all documents; XML values and nodes."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.naming import unique_names
from ..plans.registry import query
from ..sources.tables import table, to_documents


def flattened(df: DataFrame) -> DataFrame:
    """Nested fields side by side under joined names: {a: {b: 1}} becomes a_b; lists become JSON text; empty structs vanish."""
    found: list[tuple[str, Column]] = []

    def walk(kind: T.StructType, path: list[str]) -> None:
        for f in kind:
            here = [*path, f.name]
            column = F.col(".".join(f"`{p}`" for p in here))
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, here)
            else:
                found.append(("_".join(here), F.to_json(column) if isinstance(f.dataType, (T.ArrayType, T.MapType)) else column))

    walk(df.schema, [])
    names = unique_names([n for n, _ in found])
    return df.select(*[c.alias(n) for n, (_, c) in zip(names, found, strict=True)])


def value_type(kind: Column) -> Column:
    """The type of a document's field from the set of types it has: one type stands; numbers are as wide as the widest; other mixtures are text; only nulls are text."""
    some = F.array_except(kind, F.array(F.lit("VOID")))
    only = lambda *types: F.size(F.array_except(some, F.array(*[F.lit(t) for t in types]))) == 0
    mixed = F.when(only("BIGINT", WIDE), F.lit(WIDE)).when(only("BIGINT", WIDE, "DOUBLE"), F.lit("DOUBLE")).otherwise(F.lit("STRING"))
    return F.when(F.size(some) == 1, some[0]).when(F.size(some) > 1, mixed).otherwise(F.lit("STRING"))


#: The type of whole numbers beyond 64 bits.
WIDE = "DECIMAL(38,0)"


def json_type(value: Column) -> Column:
    """The type of a JSON value, from the value itself: quoted numbers are text."""
    shape = F.schema_of_variant(value)
    whole = F.regexp_extract(shape, r"^DECIMAL\((\d+),0\)$", 1)
    return (
        F.when(shape.startswith("OBJECT"), "OBJECT")
        .when(shape.startswith("ARRAY"), "ARRAY")
        .when(whole != "", F.when(whole.cast("int") > 18, WIDE).otherwise("BIGINT"))
        .when(shape.startswith("DECIMAL"), "DOUBLE")
        .otherwise(shape)
    )


#: Pairs of path and type that a task counts before it hands them on.
HELD = 100_000


class _Marked(str):
    """A number's type in place of the number."""


_WHOLE, _WIDE, _BROKEN = _Marked("BIGINT"), _Marked(WIDE), _Marked("DOUBLE")


def _number(digits: str) -> _Marked:
    """The type of a whole number, by its digits."""
    if len(digits) < 19:
        return _WHOLE
    size = len(digits.lstrip("-"))
    return _WHOLE if size <= 19 and -(1 << 63) <= int(digits) < 1 << 63 else _WIDE if size <= 38 else _BROKEN


def _fields(pairs: list[tuple]) -> dict:
    made = dict(pairs)
    if len(made) < len(pairs):
        raise ValueError("a name comes twice")
    return made


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


_READ = json.JSONDecoder(parse_int=_number, parse_float=lambda _: _BROKEN, parse_constant=_no_constant, object_pairs_hook=_fields).decode
_KINDS = {str: "STRING", _Marked: None, bool: "BOOLEAN", type(None): "VOID", list: "ARRAY"}


def _walk(text: str) -> list[tuple[tuple[str, ...], str, str]]:
    """(path above, name, type) of the fields that are no objects."""
    try:
        root = _READ(text)
    except (ValueError, RecursionError):
        return []
    out, waiting = [], [((), root)] if isinstance(root, dict) else []
    while waiting:
        path, value = waiting.pop()
        for name, v in value.items():
            kind = type(v)
            if kind is dict:
                waiting.append(((*path, name), v))
            else:
                out.append((path, name, _KINDS[kind] or v))
    return out


def typed_leaves(text: str) -> list[tuple[tuple[str, ...], str]]:
    """(path, type) of the fields of a JSON document that are no objects, as json_type() names them; none for what is no object, or can't be read."""
    return [((*path, name), str(kind)) for path, name, kind in _walk(text)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([[*p, n] for p, n, _ in counts], pa.list_(pa.string())), pa.array([str(k) for _, _, k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["path", "kind", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                counts.update(_walk(text))
        if len(counts) > HELD:
            yield made()
            counts.clear()
    yield made()


def infer_fields(documents: DataFrame, column: str) -> DataFrame:
    """(path, field, inferred, n_documents): the fields of JSON documents, at any depth, by the set of types over all documents, which are read once.

    field: the names of the path joined by underscores. Objects are walked into and are no
    fields themselves; an empty one leaves nothing. How deep documents go is not known
    before, so each is walked in Python; a task hands on one row for each path and type.
    """
    kinds = documents.select(column).mapInArrow(_counted, "path array<string>, kind string, n long")
    kinds = kinds.groupBy("path", "kind").agg(F.sum("n").alias("n"))
    found = kinds.groupBy("path").agg(F.collect_set("kind").alias("kinds"), F.sum("n").alias("n_documents"))
    return found.select("path", F.array_join("path", "_").alias("field"), value_type(F.col("kinds")).alias("inferred"), "n_documents")


def variant_path(path: list[str]) -> str | None:
    """A path as variant_get() reads it, its names quoted; None if a name has both kinds of quotes, or a closing bracket behind one."""
    if any("'" in p and '"' in p for p in path):
        return None
    return "$" + "".join(f'["{p}"]' if "'" in p else f"['{p}']" for p in path)


def field_value(document: Column, path: list[str], kind: str) -> Column:
    """The value of a field of a parsed document, as the inferred type; lists, and mixtures, as text; null where the document lacks it."""
    at = variant_path(path)
    here, at = (document, at) if at else (document, "$")
    if at == "$":
        for name in path:
            here = F.try_variant_get(here, "$", "map<string,variant>")[F.lit(name)]
    if kind in ("BIGINT", "DOUBLE", "BOOLEAN", WIDE):
        return F.try_variant_get(here, at, kind)
    held = here if at == "$" else F.try_variant_get(here, at, "variant")
    shape = F.schema_of_variant(held)
    text = F.when(shape.startswith("ARRAY") | shape.startswith("OBJECT"), F.to_json(held)).otherwise(F.try_variant_get(held, "$", "string"))
    return F.when(shape != "VOID", text)


def document_rows(documents: DataFrame, column: str, fields: list[tuple[list[str], str]]) -> DataFrame:
    """One row for each JSON document, one column for each of fields (path, type). Names are made safe and unique. Documents that are no objects are null rows."""
    order = sorted(fields)
    names = unique_names(["_".join(path) for path, _ in order])
    parsed = documents.select(F.try_parse_json(column).alias("__v"))
    return parsed.select(*[field_value(F.col("__v"), path, kind).alias(name) for name, (path, kind) in zip(names, order, strict=True)])


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """A collection that is kept as one JSON document a line: the column `document`."""
    return spark.read.text(path).withColumnRenamed("value", "document").filter(F.length(F.trim("document")) > 0)


def write_collection(df: DataFrame, path: str) -> int:
    """Writes a table as a collection, in place of what was there; how many documents."""
    seen = Observation()
    to_documents(df).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").text(path)
    return seen.get["n"]


def probe(documents: DataFrame, column: str) -> list[tuple[str, str]]:
    """(field, type) of the top-level fields of one document, for a quick look."""
    one = documents.filter(F.col(column).isNotNull()).limit(1)
    entries = one.select(F.explode(F.map_entries(F.try_variant_get(F.try_parse_json(column), "$", "map<string,variant>"))).alias("e"))
    return [(r[0], r[1] or "VOID") for r in entries.select("e.key", json_type(F.col("e.value"))).collect()]


def xml_values(rows: DataFrame, column: str, fields: str) -> DataFrame:
    """The other columns of rows, and the nodes below the root of its XML that `fields` (DDL) names, null where there is none. A text that is no XML is an error."""
    whole = F.from_xml(column, fields, {"mode": "FAILFAST", "ignoreSurroundingSpaces": "false"})
    return rows.select("*", whole.alias("__v")).select(*[F.col(f"`{c}`") for c in rows.columns if c != column], "__v.*")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def row_to_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to JSON documents and back."""
    customer = table(spark, sf_dir, "customer")
    return to_documents(customer).select(F.from_json("document", customer.schema).alias("d")).select("d.*")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k, event_type AS nested_kind_name, '[' || user_id || ',' || event_id || ']' AS nested_ids FROM events")
def document_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    nested = events.select("event_id", F.from_json("props", "k long").alias("props"), F.struct(F.struct(F.col("event_type").alias("name")).alias("kind"), F.array("user_id", "event_id").alias("ids")).alias("nested"))
    return flattened(nested)


@query("SELECT conv_id, count(*) AS n_turns, arg_min(role, turn) AS first_role, CAST(max(length(text)) AS INTEGER) AS longest FROM conversations GROUP BY 1")
def document_array_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns gathered into one document a conversation, read again."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    read = turns.select("conv_id", F.from_json(F.to_json("turns"), "array<struct<turn:long,role:string,text:string>>").alias("turns"))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.col("turns")[0]["role"].alias("first_role"), F.array_max(F.transform("turns", lambda x: F.length(x["text"]))).alias("longest"))


@query("""SELECT 'k' AS field, 'BIGINT' AS inferred, count(*) AS n_documents FROM events WHERE json_extract(props, '$.k') IS NOT NULL
UNION ALL SELECT unnest(['kind', 'mixed', 'zip', 'flag', 'wide', 'in_a', 'in_deep_b', 'in_deep_c_d_e_f', 'list', 'nothing', 'either']), unnest(['STRING', 'DOUBLE', 'STRING', 'STRING', 'DECIMAL(38,0)', 'BIGINT', 'BOOLEAN', 'DOUBLE', 'ARRAY', 'STRING', 'STRING']), count(*) FROM events""")
def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields at any depth; text that looks like a number or a truth value stays text."""
    events = table(spark, sf_dir, "events")
    number = F.col("event_id").cast("string")
    mixed = F.when(F.col("event_id") % 2 == 0, number).otherwise(F.concat(number, F.lit(".5")))
    either = F.when(F.col("event_id") % 2 == 0, "1").otherwise('"one"')
    parts = (', "kind": "', F.col("event_type"), '", "mixed": ', mixed, ', "zip": "0', number, '", "flag": "true", "wide": 1234567890123456789012, "in": {"a": 1, "deep": {"b": true, "none": {}, "c": {"d": {"e": {"f": 0.5}}}}}, "list": [1, "x"], "nothing": null, "either": ', either, "}")
    text = F.concat(F.rtrim(F.regexp_replace("props", r"\}\s*$", "")), *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return infer_fields(events.select(text.alias("d")), "d").select("field", "inferred", "n_documents")


@query("SELECT p_partkey, p_name, p_brand, p_size FROM part")
def xml_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of XML nodes by path; a missing node is null."""
    # a small file has few tasks, and its rows much work; each text is parsed once for all its values
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size").repartition("p_partkey")
    return xml_values(part.select("p_partkey", F.to_xml(F.struct("p_name", "p_brand", "p_size"), {"rowTag": "part"}).alias("x")), "x", "p_name string, p_brand string, p_size string").withColumn("p_size", F.col("p_size").cast("int"))


@query("SELECT conv_id, turn, role FROM conversations")
def xml_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One XML document a conversation, shredded into its nodes."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").alias("_turn"), "role")).alias("node"))
    xml = turns.select("conv_id", F.to_xml(F.struct("node"), {"rowTag": "conversation"}).alias("x"))
    nodes = xml.select("conv_id", F.explode(F.from_xml("x", "node array<struct<_turn:long,role:string>>")["node"]).alias("n"))
    return nodes.select("conv_id", F.col("n._turn").alias("turn"), F.col("n.role").alias("role"))


@query("""SELECT conv_id, turn, word, count(*) AS n, role || string_agg(word, '' ORDER BY k) AS whole FROM (SELECT conv_id, turn, role, word, k FROM (SELECT conv_id, turn, role, unnest(string_split(text, ' ')) AS word, unnest(generate_series(1, len(string_split(text, ' ')))) AS k FROM conversations) WHERE regexp_full_match(word, '[a-z]+')) GROUP BY conv_id, turn, role, word""")
def xml_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of nodes of XML whose names have a prefix; the text of a node is that of all nodes below it."""
    words = F.filter(F.split("text", " "), lambda w: w.rlike("^[a-z]+$"))
    turn = F.concat(F.lit('<c:turn n="'), F.col("turn").cast("string"), F.lit('"><c:role>'), "role", F.lit("</c:role>"), F.array_join(F.transform(words, lambda w: F.concat(F.lit("<c:word>"), w, F.lit("</c:word>"))), ""), F.lit("</c:turn>"))
    docs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.collect_list(turn), "").alias("x"))
    xml = docs.select("conv_id", F.concat(F.lit('<c:conversation xmlns:c="urn:c">'), "x", F.lit("</c:conversation>")).alias("x"))
    kind = "turn array<struct<_n:long,role:string,word:array<string>>>"
    turns = xml.select("conv_id", F.explode(F.from_xml("x", kind, {"ignoreNamespace": "true"})["turn"]).alias("t"))
    each = turns.select("conv_id", F.col("t._n").alias("turn"), "t.role", F.explode("t.word").alias("word"))
    return each.groupBy("conv_id", "turn", "role", "word").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.collect_list("word"), "").alias("w")).select("conv_id", "turn", "word", "n", F.concat("role", "w").alias("whole"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN role END AS role FROM conversations")
def xml_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the nodes of their XML; a row whose XML has none stays."""
    some = F.when(F.length("text") > 200, F.concat(F.lit("<node><role>"), "role", F.lit("</role></node>"))).otherwise(F.lit(""))
    xml = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("<turn>"), some, F.lit("</turn>")).alias("x"))
    nodes = xml.select("conv_id", "turn", F.explode_outer(F.from_xml("x", "node array<struct<role:string>>")["node"]).alias("n"))
    return nodes.select("conv_id", "turn", "n.role")


@query("SELECT p_partkey, p_name || p_brand AS whole FROM part")
def xml_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a node with all nodes below it."""
    xml = F.concat(F.lit("<part><a>"), F.regexp_replace("p_name", "[<&]", ""), F.lit("<b>"), "p_brand", F.lit("</b></a></part>"))
    return table(spark, sf_dir, "part").select("p_partkey", F.xpath_string(xml, F.lit("/part/a")).alias("whole"))
