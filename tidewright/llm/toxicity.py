"""Toxicity: a counterfactually regularised linear classifier on word presence.

L1-regularised logistic regression; a word is penalised the less, the more its
presence depends on the label (chi-squared), so that chance companions of a few
labelled texts stay out. For every labelled text that names an identity
group, copies are made with the term swapped for each other term of its kind, and
the squared change of the score between text and copy is part of the loss: a group's
name then gains no weight of its own, so neutral mentions are not called toxic.

Defined cases: a null text counts as empty and gets the model's base score; labels
that are null, or whose document is missing, are not used; a document labelled more
than once, or equal texts labelled differently, count with the highest label; without
both classes the score is the share of the one there is (0.0 without labels). Only the
text enters a score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, cut, unused, utf8

#: Identity terms by kind; a term is swapped for the others of its kind: fixed values.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees", "citizens"),
    ("disabled", "deaf", "blind", "autistic"),
    ("old", "young"),
)


@dataclass
class Model:
    """Score: logistic of bias plus the weights of the distinct words in the text."""

    weights: dict[bytes, float]
    bias: float

    def score(self, words: set[bytes]) -> float:
        z = self.bias + math.fsum(self.weights[w] for w in self.weights.keys() & words)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def fit(rows: list[np.ndarray], labels: np.ndarray, swaps: list[tuple[np.ndarray, np.ndarray]], n_features: int, l1: np.ndarray, counterfactual: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias, by accelerated proximal gradient descent.

    rows: features of each text; swaps: features that a swap adds and takes away;
    l1: the penalty on each weight.
    Classes weigh the same in the loss.
    """
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    s_flat = np.concatenate([np.concatenate([a, b]) for a, b in swaps] + [np.zeros(0, np.int64)]).astype(np.int64)
    s_sign = np.concatenate([np.concatenate([np.ones(len(a)), -np.ones(len(b))]) for a, b in swaps] + [np.zeros(0)])
    s_of = np.repeat(np.arange(len(swaps)), [len(a) + len(b) for a, b in swaps])

    def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float, float]:
        z = np.bincount(of, w[flat], len(rows)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        loss = float(share @ (np.logaddexp(0, z) - labels * z))
        e = share * (p - labels)
        g = np.bincount(flat, e[of], n_features)
        if swaps:
            change = np.bincount(s_of, s_sign * w[s_flat], len(swaps))
            loss += counterfactual * float(change @ change) / len(swaps)
            g = g + 2 * counterfactual / len(swaps) * np.bincount(s_flat, s_sign * change[s_of], n_features)
        return g, float(e.sum()), loss

    w, b = np.zeros(n_features), 0.0
    v, c, t, rate = w.copy(), b, 1.0, 1.0
    for _ in range(steps):
        g, gb, loss = gradient(v, c)
        while True:
            x = v - rate * g
            x = np.sign(x) * np.maximum(np.abs(x) - rate * l1, 0)
            y = c - rate * gb
            d, db = x - v, y - c
            if gradient(x, y)[2] <= loss + g @ d + gb * db + (d @ d + db * db) / (2 * rate) + 1e-12 or rate < 1e-6:
                break
            rate /= 2
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = x + (t - 1) / t2 * (x - w), y + (t - 1) / t2 * (y - b)
        w, b, t, rate = x, y, t2, rate * 1.3
    return w, b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable: Column | None = None,
          identity: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, sample: int = 5000, features: int = 20_000, least_texts: int = 4, l1: float = 5e-5, counterfactual: float = 10.0) -> Model:
    """Fits the model on at most `sample` labelled texts of each class (those whose id hashes lowest) and `features` words.

    usable: which rows of labels may be learned from. Of an id that several texts have,
    the text of the smallest hash counts, so that `sample` bounds the texts too. What
    reaches the driver is bounded by sample and features; words are weighed and counted by
    Spark.
    """
    given = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (F.lit(True) if usable is None else usable))
    given = given.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    picked = [given.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    ids = F.broadcast(picked[0].union(picked[1]))  # 2 * sample rows at most

    @F.arrow_udf("array<binary>")
    def distinct(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(set(alnum_words(t))) for t in texts.to_pylist()], pa.list_(pa.binary()))

    held = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    # one text for each id: found by hashes, before any text is moved
    one = F.broadcast(cut(held.join(ids, "id").groupBy("id", "y").agg(F.min("h").alias("h"))))
    texts = held.join(one, ["id", "h"]).groupBy("h").agg(F.max("y").alias("y"), F.first("t").alias("t")).select("y", distinct("t").alias("words")).persist()
    try:
        n = dict(texts.groupBy("y").count().collect())
        if not n.get(0) or not n.get(1):
            share = 1.0 if n.get(1) else 0.0
            return Model({}, 40.0 if share else -40.0)
        named = [t.encode() for kind in identity for t in kind]
        df = texts.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("all"))
        odds = F.abs(F.log((F.col("bad") + 0.5) / (n[1] + 1)) - F.log((F.col("all") - F.col("bad") + 0.5) / (n[0] + 1))) * F.sqrt("all")
        chosen = df.filter(F.col("all") >= least_texts).orderBy(odds.desc(), "w").limit(features).union(df.filter(F.col("w").isin(named)))
        counted = {bytes(r.w): (r.bad, r.all) for r in chosen.collect()}
        words = sorted(counted)
        at = {w: i for i, w in enumerate(words)}
        kinds = {t.encode(): [o.encode() for o in kind if o != t] for kind in identity for t in kind}
        known = docs.sparkSession.sparkContext.broadcast(at)

        @F.arrow_udf("array<int>")
        def featured(lists: pa.Array) -> pa.Array:
            return pa.array([[known.value[w] for w in x if w in known.value] for x in lists.to_pylist()], pa.list_(pa.int32()))

        got = texts.select("y", featured("words").alias("f"), F.filter("words", lambda w: w.isin(named)).alias("named")).toArrow()
    finally:
        texts.unpersist()
    lists = got["f"].combine_chunks()
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    rows = [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    # terms that only a swap brings in get features of their own
    for group in kinds.values():
        for w in group:
            at.setdefault(w, len(at))
    swaps = []
    for own in got["named"].to_pylist():
        have = set(own)
        for w in own:
            swaps += [(np.array([] if o in have else [at[o]], np.int64), np.array([at[w]], np.int64)) for o in kinds[w]]
    # dependence on the label: chi-squared of the two-by-two table, as a share of the largest
    total = n[0] + n[1]
    a, k = np.array([counted.get(w, (0, 0)) for w in at], float).T
    lean = np.abs(a * total - k * n[1]) / np.sqrt(np.maximum(k * (total - k), 1.0))
    penalty = l1 / np.maximum(lean / max(float(lean.max()), 1e-12), 0.02)
    weights, bias = fit(rows, np.array(got["y"].to_pylist(), float), swaps, len(at), penalty, counterfactual)
    return Model({w: float(weights[i]) for w, i in at.items() if abs(weights[i]) > 1e-6}, float(bias))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score column of docs' text, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # at most `features` weights
    made: list[Model] = []

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Model(*shared.value))
        return pa.array([made[0].score(set(alnum_words(t))) for t in texts.to_pylist()], pa.float64())

    return scored(utf8(text_col))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo 5, is 0. A null id is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def keep_civil(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with their columns as they were."""
    (own,) = unused(docs, "__score")
    return docs.select([F.col(f"`{c}`") for c in docs.columns] + [score(docs, model, text_col).alias(own)]).filter(F.col(own) < threshold).drop(own)
