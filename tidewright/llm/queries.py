"""The registered queries of the corpus operators, with their digests, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, fill_middle, fingerprints, licenses, line_dedup, mixing, secret_scan, sharding, simhash_dedup, token_alignment, token_counts, toxicity
from .common import table

#: The vocabulary that op1 counts with: a parameter of the operator, read where public tokenizer files are installed.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The tokenizers of op11 and op13, parameters likewise.
BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


def op1_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Three edits of every document: a phrase put over a third, 40 characters cut from the middle, a sentence at the end."""
    n = F.coalesce(F.length("text"), F.lit(0))
    third, middle = F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int")
    edit = lambda start, stop, put: F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), F.lit(put).alias("put"))
    edits = F.array(edit(third, third + 12, " was revised and "), edit(middle, middle + 40, ""), edit(n + 5, n + 5, " The end."))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits"))
    return token_counts.count_with_edits(docs, vocabulary)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=~toxicity.held_out())
    scored = docs.select("doc_id", toxicity.held_out().alias("held_out"), toxicity.score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_deleted", "longest", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_near: for ids divisible by 100, how many rows of the table are within 3 bits (the document itself too); else null."""
    made = fingerprints.cut(fingerprints.edit_fingerprints(table(spark, sf_dir, "documents")))
    near = fingerprints.within(made.filter(F.col("id") % 100 == 0), made)
    asked = made.filter(F.col("id") % 100 == 0).join(near, ["hi", "lo"])
    rest = made.filter(F.coalesce(F.col("id") % 100 != 0, F.lit(True))).withColumn("n_near", F.lit(None).cast("long"))
    return asked.select(*rest.columns).union(rest).select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", fingerprints.as_hex("hi", "lo").alias("fingerprint"), fingerprints.as_hex("ehi", "elo").alias("edited_fingerprint"),
        fingerprints.likeness("hi", "lo", "ehi", "elo").alias("near_edited"), fingerprints.likeness("hi", "lo", "nhi", "nlo").alias("near_next"), "n_near",
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    counts = [secret_scan.count_of("base", k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed("base").cast("binary"), 256).alias("base_sha256"), secret_scan.listed("spans").alias("spans"))


def op11_chat_format(spark: SparkSession, sf_dir: str, tokenizer: str = BYTE_BPE) -> DataFrame:
    """All conversations and one more, whose texts are made of control strings; read back from what was written."""
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    found = chat_format.read_back(chat_format.cut(chat_format.format_chats(talks, tokenizer)))
    return found.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.fill_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fill_middle.restored("output", "form")).alias("restored_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    found = token_alignment.alignment(table(spark, sf_dir, "documents"), byte_bpe, piece_bpe)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_token_counts, op2_mixing, op3_simhash_dedup, op4_toxicity, op5_license_scan, op6_line_dedup, op7_decontamination, op8_fingerprints, op9_sharding, op10_secret_scan, op11_chat_format, op12_fill_middle, op13_token_alignment)
    return {f.__name__: f for f in made}


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
b AS (SELECT item_id, {WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(ws[p:p + least(13, len(ws)) - 1], ' ') AS w, least(13, len(ws)) AS l
        FROM (SELECT item_id, ws, unnest(generate_series(1, len(ws) - least(13, len(ws)) + 1)) AS p FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT l FROM win),
places AS (SELECT doc_id, p, l, array_to_string(ws[p:p + l - 1], ' ') AS w
           FROM (SELECT doc_id, ws, l, unnest(generate_series(1, len(ws) - l + 1)) AS p FROM d, sizes WHERE len(ws) >= l)),
hit AS (SELECT doc_id, p, l, item_id FROM places JOIN win USING (w, l)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + l - 1)) AS q FROM (SELECT DISTINCT doc_id, p, l FROM hit)) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def line_dedup_sql(min_lines: int = 3, min_words: int = 50) -> str:
    """Runs of l lines, l one more each round; a run's later copies are numbered from 2."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
pos AS (SELECT doc_id, i, ls[i] AS line, len(regexp_extract_all(ls[i], '\S+')) AS words FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM d)),
run AS (
    SELECT doc_id, i, 1 AS l, w, nth FROM (SELECT doc_id, i, md5(line) AS w, count(*) OVER (PARTITION BY line) AS n, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS nth FROM pos) WHERE n > 1
    UNION ALL
    SELECT doc_id, i, l, w, nth FROM (SELECT doc_id, i, l, w, count(*) OVER (PARTITION BY w) AS n, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS nth
        FROM (SELECT r.doc_id, r.i, r.l + 1 AS l, md5(r.w || md5(p.line)) AS w FROM run r JOIN pos p ON p.doc_id = r.doc_id AND p.i = r.i + r.l)) WHERE n > 1
),
sized AS (SELECT r.doc_id, r.i, r.l, sum(p.words) AS words FROM run r JOIN pos p ON p.doc_id = r.doc_id AND p.i BETWEEN r.i AND r.i + r.l - 1 WHERE r.nth > 1 AND r.l <= {min_lines} GROUP BY 1, 2, 3),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + l - 1)) AS i FROM sized WHERE l = {min_lines} OR words >= {min_words}),
longest AS (SELECT doc_id, max(l) AS longest FROM run WHERE nth > 1 GROUP BY 1),
kept AS (SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.i) AS kept FROM pos p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i WHERE g.i IS NULL GROUP BY 1),
n_gone AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, coalesce(n, 0) AS n_deleted, CAST(coalesce(longest, 0) AS BIGINT) AS longest, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n_gone USING (doc_id) LEFT JOIN longest USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
s AS (SELECT *, length('<|im_start|><|im_sep|><|im_end|>') + length(role) + length(text) + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|')) AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""

FILL_MIDDLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT *, length(t) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_decontamination": DECONTAMINATION_SQL, "op6_line_dedup": line_dedup_sql(), "op11_chat_format": CHAT_SQL, "op12_fill_middle": FILL_MIDDLE_SQL}
