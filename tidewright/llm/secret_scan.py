"""Secret scans: patterns, and character Markov models compared by log-likelihood ratio.

First-order models of random strings stand against one of ordinary identifiers and words
(of labelled sample texts without a find). The random ones are trained on what the patterns
found in labelled sample texts, in both cases of letters; the alphabets that the patterns
allow have one each, as a sample need not hold every kind of secret. A long token is a
secret when its characters are likelier by a margin under one of them. DataFrame functions
only; the scan itself needs no shuffle, and its steps grow with the characters of a text
and, but for a logarithm, with its finds.

Defined cases: a null text counts as empty; a text without finds gets zero counts,
the digest of the empty string and empty spans; repeated rows are each scanned;
characters outside the models' alphabet part tokens; without any labelled find the
trained random model is uniform; the sample takes rows by id and text, so that ids which
repeat, or are null, bring in no more than others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Patterns by kind, in the order of ties: fixed values of the contract. The second: least characters of the whole find; the third: of group 2.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 0, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 20, 0),
    ("hex", r"[0-9a-f]{24,}", 24, 0),
)
#: The models' characters: fixed values.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Alphabets that secrets are drawn from evenly, where no sample says otherwise: those of the patterns.
EVEN = ("0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
TOKEN = r"[A-Za-z0-9+/_=-]"
SPAN = "struct<start:int,kind_no:int,kind:string,stop:int>"
FOUND = "struct<start:int,kind_no:int,kind:string,stop:int,find:string>"
#: Behind the end of any text.
END = (1 << 31) - 1


def running(values: Column, step, neutral) -> Column:
    """For each element of an array what `step` makes of it and all before it, by doublings: in n log n steps for n elements."""
    size = F.size(values)
    doublings = F.sequence(F.lit(0), F.ceil(F.log2(size)).cast("int") - 1)

    def doubled(acc: Column, k: Column) -> Column:
        shift = F.pow(F.lit(2), k).cast("int")
        return F.zip_with(F.slice(F.concat(F.array_repeat(F.lit(neutral), shift), acc), 1, size), acc, step)

    return F.when(size > 1, F.aggregate(doublings, values, doubled)).otherwise(values)


def found_spans(df: DataFrame, kind_no: int, kind: str, pattern: str, least: int = 0, group_least: int = 0) -> DataFrame:
    """df (with column t) plus the column named by kind: array of SPAN, the pattern's finds in t that are long enough.

    A find's place is the length of the stretches between finds and of the finds before it, in code points.
    """
    m, g, at = f"__{kind}_m", f"__{kind}_g", f"__{kind}_at"
    df = df.withColumn(m, F.regexp_extract_all("t", F.lit(pattern), F.lit(0)))
    some = F.size(m) > 0
    df = df.withColumn(g, F.when(some, F.regexp_extract_all("t", F.lit(pattern), F.lit(2)) if group_least else F.col(m)))
    gaps = F.transform(F.split("t", pattern, -1), lambda x: F.length(x))
    steps = F.zip_with(F.slice(gaps, 1, F.size(m)), F.concat(F.array(F.lit(0)), F.transform(F.slice(m, 1, F.size(m) - 1), lambda x: F.length(x))), lambda gap, before: gap + before)
    df = df.withColumn(at, F.when(some, running(steps, lambda a, b: a + b, 0)))
    pieces = F.filter(F.arrays_zip(F.col(at).alias("at"), F.col(m).alias("m"), F.col(g).alias("g")), lambda x: (F.length(x["m"]) >= least) & (F.length(x["g"]) >= group_least))
    spans = F.transform(pieces, lambda x: F.struct(x["at"].alias("start"), F.lit(kind_no).alias("kind_no"), F.lit(kind).alias("kind"), (x["at"] + F.length(x["m"])).alias("stop"), x["m"].alias("find")))
    return df.withColumn(kind, F.when(some, spans).otherwise(F.array().cast(f"array<{FOUND}>"))).drop(m, g, at)


def free_of(found: Column, base: Column) -> Column:
    """The elements of `found` that overlap none of `base`: beside each, how far the base finds before it reach and where the next one starts."""
    every = F.array_sort(F.concat(base, found))
    own = lambda x: x["kind_no"] == len(BASE)
    reach = running(F.transform(every, lambda x: F.when(own(x), 0).otherwise(x["stop"])), lambda a, b: F.greatest(a, b), 0)
    following = F.reverse(running(F.transform(F.reverse(every), lambda x: F.when(own(x), END).otherwise(x["start"])), lambda a, b: F.least(a, b), END))
    beside = F.arrays_zip(every.alias("x"), reach.alias("reach"), following.alias("following"))
    free = F.filter(beside, lambda y: own(y["x"]) & (y["reach"] <= y["x"]["start"]) & (y["following"] >= y["x"]["stop"]))
    return F.transform(free, lambda y: y["x"])


def _base_secrets(texts: DataFrame) -> DataFrame:
    """(w): distinct strings that the patterns call secrets."""
    parts = [F.regexp_extract_all("t", F.lit(p), F.lit(2 if least2 else 0)) for _, p, _, least2 in BASE]
    listed = texts.select(F.explode(F.concat(*parts)).alias("w")).filter(F.length("w") >= 6)
    return listed.select(F.explode(F.regexp_extract_all("w", F.lit(f"{TOKEN}+"), F.lit(0))).alias("w")).filter(F.length("w") >= 6).distinct()


def characters(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def _bigrams(words: DataFrame) -> dict[str, int]:
    """Counts of neighbouring characters: at most the square of the alphabet."""
    apart = words.select(characters(F.col("w")).alias("c"))
    pairs = apart.select(F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: F.concat(a, b))).alias("p"))
    return {r.p: r.n for r in pairs.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 2000, smooth: float = 0.5, flat: float = 0.02) -> list[float]:
    """The first of train_models(): what the sample's own finds say."""
    return train_models(docs, id_col, text_col, sample, smooth, flat)[0]


def train_models(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 2000, smooth: float = 0.5, flat: float = 0.02) -> list[list[float]]:
    """For each random model the log-likelihood ratios of all character pairs, row by row of the alphabet.

    Labels: in at most `sample` rows with a pattern find and `sample` without (those
    whose id hashes lowest, then whose text does), finds are random strings and other words
    identifiers. flat: weight of the uniform model mixed into the trained ones.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("th", F.xxhash64("t"))
    # every find has one of these
    marked = cut(texts.select("id", "th", F.xxhash64("id").alias("h"), F.col("t").rlike("|".join(f"(?:{p})" for _, p, _, _ in BASE)).alias("found")))
    lowest = [marked.filter(F.col("found") == x).orderBy("h", "id", "th").limit(sample) for x in (True, False)]
    # 2 * sample rows at most; their texts come by a join, not through the sort
    rows = lowest[0].union(lowest[1]).select(F.col("id").alias("picked"), F.col("th").alias("picked_th"), "found").distinct()
    picked = texts.join(F.broadcast(rows), F.col("id").eqNullSafe(F.col("picked")) & (F.col("th") == F.col("picked_th"))).select("t", "found")
    secrets = _base_secrets(picked.filter("found"))
    random = _bigrams(secrets)
    upper = _bigrams(secrets.select(F.upper("w").alias("w")).filter(F.lower("w") != F.col("w")))
    words = picked.filter(~F.col("found")).select(F.explode(F.regexp_extract_all("t", F.lit(f"{TOKEN}+"), F.lit(0))).alias("w")).filter(F.length("w") >= 4).distinct()
    size = len(ALPHABET)

    def trained(counts: dict[str, int]) -> list[float]:
        """Log probabilities of the second character of each pair."""
        out = []
        for a in ALPHABET:
            row = sum(counts.get(a + b, 0) for b in ALPHABET)
            out += [math.log((1 - flat) * (counts.get(a + b, 0) + smooth) / (row + smooth * size) + flat / size) for b in ALPHABET]
        return out

    ordinary = trained(_bigrams(words))
    even = [[math.log((1 - flat / 4) / len(own) * (b in own) + flat / 4 / size) for _ in ALPHABET for b in ALPHABET] for own in EVEN]
    return [[x - y for x, y in zip(model, ordinary, strict=True)] for model in (trained(random), trained(upper), *even)]


def likelihood_ratio(token: Column, ratios: list[list[float]]) -> Column:
    """The largest of the sums of each model's ratios over the token's character pairs."""
    tables = [F.array(*[F.lit(round(x, 6)) for x in model]) for model in ratios]
    # the place of each character with that of the one before it (0: none)
    at = lambda acc, c: F.greatest(F.lit(1), (acc["last"] - 1) * len(ALPHABET) + F.instr(F.lit(ALPHABET), c))
    pair = lambda acc, c: F.struct(
        *[(acc[f"s{n}"] + F.when(acc["last"] > 0, F.element_at(t, at(acc, c))).otherwise(0.0)).alias(f"s{n}") for n, t in enumerate(tables)],
        F.instr(F.lit(ALPHABET), c).alias("last"),
    )
    start = F.struct(*[F.lit(0.0).alias(f"s{n}") for n in range(len(tables))], F.lit(0).alias("last"))
    return F.aggregate(characters(token), start, pair, lambda acc: F.greatest(F.lit(-math.inf), *[acc[f"s{n}"] for n in range(len(tables))]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratios: list[float] | list[list[float]] | None = None, least: int = 20, margin: float = 12.0) -> DataFrame:
    """(id_col, base, spans): arrays of SPAN in order of start, then kind; spans also has the Markov finds, which overlap no base find.

    ratios: the tables of train_models(), or one of them; learned from docs if not given.
    least: characters of a token; margin: log-likelihood ratio from which it is a secret.
    """
    ratios = train_models(docs, id_col, text_col) if ratios is None else ratios
    tables = ratios if isinstance(ratios[0], list) else [ratios]
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    for n, (kind, pattern, whole, group) in enumerate(BASE):
        df = found_spans(df, n, kind, pattern, whole, group)
    df = found_spans(df, len(BASE), "markov", f"{TOKEN}{{{least},}}", least)
    df = df.withColumn("listed", F.array_sort(F.concat(*[k for k, _, _, _ in BASE])))
    likely = F.filter(free_of(F.col("markov"), F.col("listed")), lambda x: likelihood_ratio(x["find"], tables) >= margin)
    spans = F.when(F.size("markov") > 0, F.array_sort(F.concat("listed", likely))).otherwise(F.col("listed"))
    plain = lambda found: F.transform(found, lambda x: F.struct(*[x[f].alias(f) for f in ("start", "kind_no", "kind", "stop")]))
    return df.select(F.col("id").alias(id_col), plain(F.col("listed")).alias("base"), plain(spans).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:stop of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
