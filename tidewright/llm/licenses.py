"""License scans by diagonal voting.

All rolling word k-grams of a text are held against the templates' k-grams; a hit
of text position p on template position q votes for the diagonal p - q. Spark joins
the hits to template positions, counts votes by diagonal, merges neighbouring
diagonals (a word put in or left out moves the diagonal) into spans, and verifies
each span's share of the template.

Defined cases: a null text counts as empty and has no words; a text without hits
gets zero counts, null positions, empty labels and score 0; repeated rows are
each scanned; columns other than id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import alnum_words, cut, utf8
from .kgrams import Scanner, key_of

#: Phrases whose every place counts, with their labels: fixed values of the contract.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further phrases, with their labels: fixed values.
MORE_PHRASES = {
    "cc by": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "creative commons": "cc",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "isc license": "isc",
    "the unlicense": "unlicense",
    "all rights reserved": "proprietary",
}
#: Notices of public licenses, with their labels: fixed values.
NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
}


@dataclass
class Templates:
    """Phrases (found whole or not at all) and notices (found by a share of their k-grams)."""

    base: dict[str, str] = field(default_factory=lambda: dict(BASE_PHRASES))
    phrases: dict[str, str] = field(default_factory=lambda: dict(MORE_PHRASES))
    notices: dict[str, str] = field(default_factory=lambda: dict(NOTICES))
    phrase_k: int = 2
    notice_k: int = 4

    def rows(self) -> tuple[list[tuple], dict[bytes, int], dict[int, list[int]]]:
        """(template, label, kind, grams, key, q) for each k-gram; the vocabulary; the keys by k."""
        rows, words, keys = [], {}, {self.phrase_k: [], self.notice_k: []}
        listed = [(t, x, "base", self.phrase_k) for t, x in self.base.items()] + [(t, x, "phrase", self.phrase_k) for t, x in self.phrases.items()] + [(t, x, "notice", self.notice_k) for x, t in self.notices.items()]
        for n, (text, label, kind, k) in enumerate(listed):
            ids = [words.setdefault(w, len(words) + 1) for w in alnum_words(text.encode())]
            if len(ids) < k:
                raise ValueError(f"a template of fewer than {k} words: {text!r}")
            grams = [key_of(ids[i : i + k]) for i in range(len(ids) - k + 1)]
            keys[k] += grams
            rows += [(n, label, kind, len(grams), k, g, q) for q, g in enumerate(grams)]
        return rows, words, keys


def gram_hits(docs: DataFrame, id_col: str, text_col: str, words: dict[bytes, int], keys: dict[int, list[int]]) -> DataFrame:
    """(row, id, n_words, hits): the places of known k-grams in each row's text. row tells repeated rows apart."""
    known = docs.sparkSession.sparkContext.broadcast((words, keys))  # as large as the templates
    made: list[Scanner] = []

    @F.arrow_udf("struct<n_words:long,hits:array<struct<p:int,key:long>>>")
    def scanned(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Scanner(*known.value))
        counts, offsets, places, found = [], [0], [], []
        for at in range(0, len(texts), 256):
            ids, starts, sizes = made[0].read(texts[at : at + 256].to_pylist())
            p, key = made[0].find(ids)
            of = np.searchsorted(starts, p, side="right") - 1
            counts.append(sizes)
            places.append(p - starts[of])
            found.append(key)
            offsets += (offsets[-1] + np.cumsum(np.bincount(of, minlength=len(sizes)))).tolist()
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        hits = pa.StructArray.from_arrays([pa.array(join(places).astype(np.int32)), pa.array(join(found))], ["p", "key"])
        return pa.StructArray.from_arrays([pa.array(join(counts)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), hits)], ["n_words", "hits"])

    read = docs.select(F.col(id_col).alias("id"), scanned(utf8(text_col)).alias("s"))
    return cut(read.select(F.monotonically_increasing_id().alias("row"), "id", "s.n_words", "s.hits"))


def license_spans(scanned: DataFrame, rows: list[tuple], slack: int = 8, share: float = 0.6) -> DataFrame:
    """(row, label, kind, first, stop, coverage): verified spans; phrases on their own diagonal, notices over merged ones."""
    spark = scanned.sparkSession
    positions = spark.createDataFrame(rows, "template int, label string, kind string, grams int, k int, key long, q int")
    hits = scanned.select("row", F.explode("hits").alias("h")).select("row", "h.p", "h.key")
    votes = hits.join(F.broadcast(positions), "key").withColumn("diagonal", F.col("p") - F.col("q"))
    by = ["row", "template", "label", "kind", "grams"]
    # a k-gram that a notice repeats votes for several diagonals: only for the one with the most votes does it count, so that strays do not part neighbours
    backed = votes.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("row", "template", "diagonal")))
    best = Window.partitionBy("row", "template", "p").orderBy(F.desc("n"), "q")
    votes = backed.withColumn("best", F.row_number().over(best)).filter("best = 1 or kind != 'notice'")
    diagonals = votes.groupBy(*by, "diagonal").agg(F.count(F.lit(1)).alias("votes"), F.min("p").alias("first"), F.max(F.col("p") + F.col("k")).alias("stop"))
    whole = diagonals.filter((F.col("kind") != "notice") & (F.col("votes") == F.col("grams"))).select("row", "label", "kind", "first", "stop", F.lit(1.0).alias("coverage"))
    order = Window.partitionBy("row", "template").orderBy("first", "diagonal")
    apart = (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > slack) | (F.col("first") - F.lag("stop").over(order) > slack)
    merged = (
        diagonals.filter("kind = 'notice'")
        .withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("span", F.sum("new").over(order))
        .groupBy(*by, "span")
        .agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("stop").alias("stop"))
        .withColumn("coverage", F.least(F.lit(1.0), F.col("votes") / F.col("grams")))
        .filter((F.col("coverage") >= share) & (F.col("stop") - F.col("first") <= 2 * F.col("grams")))
    )
    return whole.union(merged.select("row", "label", "kind", "first", "stop", "coverage"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Templates | None = None, slack: int = 8, share: float = 0.6) -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score), one row for each of docs.

    score: the best coverage of any template (1 for a phrase); 0 without a span.
    """
    rows, words, keys = (templates or Templates()).rows()
    scanned = gram_hits(docs, id_col, text_col, words, keys)
    spans = license_spans(scanned, rows, slack, share)
    base = F.col("kind") == "base"
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy("row").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        listed(F.when(base, F.col("label"))).alias("base_labels"),
        listed("label").alias("labels"),
        F.max("coverage").alias("score"),
    )
    return scanned.select("row", "id", "n_words").join(found, "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
