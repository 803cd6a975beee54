"""Licence scans: a trained paragraph classifier over word n-grams, confirmed against templates.

Training happens on the notices below, cut and varied by rule, against paragraphs of a bounded
sample of documents.  Scoring is relational: words and word pairs of every paragraph of every
document meet the model's non-zero weights in a join; paragraphs without any such n-gram have the score of the
intercepts, which is "none".
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import unit

# Customary notices of each family.
NOTICES = {
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "This program is free software under the terms of the GNU Affero General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: AGPL-3.0"],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache 2.0 license."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3-Clause License.", "Licensed under the BSD license.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GPL."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: LGPL-2.1"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0", "Released into the public domain."],
}
#: Notices that are about licences but of no family; they teach the unknown class.
UNKNOWN_NOTICES = ["All rights reserved.", "See the license file for details.", "Licensed under the terms of the agreement.", "Released under the license of the author.",
                   "This work is licensed under the terms below.", "Use is subject to the license.", "Copyright by the authors.", "Licensed under the Example Open License, version 1.0.", "SPDX-License-Identifier: LicenseRef-Other"]
NONE, UNKNOWN = "none", "unknown"
FAMILIES = sorted(NOTICES)
CLASSES = [NONE, UNKNOWN, *FAMILIES]
# A paragraph of no family must hold one of these to be about a licence.
TERMS = ["license", "licence", "licensed", "licenses", "copyright", "spdx-license-identifier", "rights", "permission", "permitted", "redistribution", "domain"]
#: The negatives: paragraphs of about this many documents.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS = 2000, 6000
STEPS, RATE, PENALTY, LEAST_WEIGHT = 300, 0.1, 1e-4, 0.02
#: A family needs this calibrated probability, and this share of the words of one of its notices.
LEAST_PROBABILITY, LEAST_COVER = 0.5, 0.75
WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def grams(text: str) -> list[str]:
    w = re.findall(WORD, text.lower())
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def varied(text: str) -> list[str]:
    """The notice, with other words around it, and without its first or last words."""
    w = text.split()
    out = [text, text.upper(), f"Copyright 2024 the authors. {text}", f"{text} See the file for details."]
    return out + [" ".join(w[k:]) for k in (1, 2) if len(w) - k >= 5] + [" ".join(w[:-k]) for k in (1, 2) if len(w) - k >= 5]


def examples() -> list[tuple[str, str]]:
    return [(v, family) for family, texts in (*NOTICES.items(), (UNKNOWN, UNKNOWN_NOTICES)) for t in texts for v in varied(t)]


def fit(texts: list[str], labels: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Multinomial logistic regression over counts of the notices' n-grams: weights by n-gram, intercepts, and the
    temperature that calibrates the probabilities on every fifth example, which the weights don't see."""
    number = {g: i for i, g in enumerate(sorted({g for t, c in zip(texts, labels) if c != NONE for g in grams(t)}))}
    rows, cols = [], []
    for i, t in enumerate(texts):
        for g in grams(t):
            if g in number:
                rows.append(i)
                cols.append(number[g])
    rows, cols = np.array(rows), np.array(cols)
    y = np.array([CLASSES.index(x) for x in labels])
    held = np.arange(len(y)) % 5 == 4
    own = ~held
    # every class has the same total weight
    weight = own / np.maximum(np.bincount(y[own], minlength=len(CLASSES)), 1)[y]
    weight /= weight.sum()
    w, b = np.zeros((len(number), len(CLASSES))), np.zeros(len(CLASSES))
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)

    def scores():
        s = np.tile(b, (len(y), 1))
        np.add.at(s, rows, w[cols])
        return s

    def softmax(s):
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    hot = np.eye(len(CLASSES))[y]
    for step in range(1, STEPS + 1):
        d = (softmax(scores()) - hot) * weight[:, None]
        gw = PENALTY * w
        np.add.at(gw, cols, d[rows])
        gb = d.sum(axis=0)
        for p, g, m, v in ((w, gw, mw, vw), (b, gb, mb, vb)):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (1 - step / STEPS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    s = scores()[held]
    loss = {t: -np.mean(np.log(np.maximum(softmax(s / t)[np.arange(len(s)), y[held]], 1e-9))) for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
    temperature = min(loss, key=loss.get) if len(s) else 1.0
    return {g: w[i] for g, i in number.items()}, b, temperature


def train(docs: DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Fit on the notices and on paragraphs of a bounded sample of documents as negatives.

    Sampled paragraphs that share a pair of words with a notice are left out, since they may hold one.
    """
    pairs = {g for t, _ in examples() for g in grams(t) if " " in g}
    total = max(docs.select("doc_id").count(), 1)
    sample = docs.where(unit(F.col("doc_id"), "licence:") < SAMPLE_DOCS / total)
    lines = sample.select(F.explode(F.split("text", "\n")).alias("p")).where("length(p) BETWEEN 5 AND 2000")
    lines = [r["p"] for r in lines.orderBy(F.xxhash64("p")).limit(SAMPLE_PARAGRAPHS).collect()]
    negative = [p for p in lines if not pairs.intersection(grams(p))]
    shown = examples()
    return fit([t for t, _ in shown] + negative, [c for _, c in shown] + [NONE] * len(negative))


def scan(docs: DataFrame, model=None) -> DataFrame:
    """doc_id, licence, probability, n_notices, confirmed of every document (doc_id, text).

    ``licence`` is the most probable family among the document's paragraphs that the templates confirm;
    ``unknown`` if only paragraphs about some licence were found; ``none`` otherwise.  ``n_notices`` counts
    paragraphs that are about a licence.  Null and empty texts have none.  Rows that share a doc_id but
    not the text are kept apart, repeated rows stay, an empty table gives an empty result, other columns are ignored.
    """
    spark = docs.sparkSession
    weights, intercepts, temperature = model or train(docs)
    rows = [(g.split(" ")[0], g.split(" ")[1] if " " in g else None, (v - v[0]).tolist()) for g, v in weights.items() if np.abs(v - v[0]).max() >= LEAST_WEIGHT]
    model_rows = F.broadcast(spark.createDataFrame(rows, "w0 string, w1 string, v array<double>"))  # n-grams of the notices alone
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    # repeated rows are summed one by one, so each has a number within this scan
    p = docs.select("doc_id", "text_key", F.monotonically_increasing_id().alias("row"), F.posexplode(F.split("text", "\n")).alias("par", "text"))
    p = p.select("doc_id", "text_key", "row", "par", words_of(F.col("text")).alias("w"))
    pairs = p.select("doc_id", "text_key", "row", "par", F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b"))).alias("g"))
    a, b = (F.col("g").getField(n) for n in pairs.schema["g"].dataType.names)
    hits = pairs.select("doc_id", "text_key", "row", "par", a.alias("w0"), b.alias("next")).join(model_rows, "w0").where("w1 IS NULL OR w1 = next")
    sums = [F.sum(F.get("v", F.lit(k))).alias(f"s{k}") for k in range(len(CLASSES))]
    found = hits.groupBy("doc_id", "text_key", "row", "par").agg(*sums, F.collect_set("w0").alias("words"))
    s = F.array(*[(F.col(f"s{k}") + float(intercepts[k] - intercepts[0])) / temperature for k in range(len(CLASSES))])
    found = found.withColumn("s", s).withColumn("top", F.array_max("s")).withColumn("best", F.array_position("s", F.col("top")).cast("int") - 1)
    found = found.withColumn("probability", 1 / F.aggregate("s", F.lit(0.0), lambda t, x: t + F.exp(x - F.col("top")))).where("best > 0")
    templates = F.create_map(*[x for f in FAMILIES for x in (F.lit(f), F.array(*[F.array(*[F.lit(w) for w in sorted(set(re.findall(WORD, t.lower())))]) for t in NOTICES[f]]))])
    name = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("best") + 1)
    cover = F.aggregate(F.coalesce(templates[F.col("class")], F.array().cast("array<array<string>>")), F.lit(0.0),
                        lambda m, t: F.greatest(m, F.size(F.array_intersect(t, F.col("words"))) / F.size(t)))
    found = found.withColumn("class", name).withColumn("cover", cover)
    sure = (F.col("class") != UNKNOWN) & (F.col("probability") >= LEAST_PROBABILITY) & (F.col("cover") >= LEAST_COVER)
    found = found.where(sure | F.arrays_overlap("words", F.array(*[F.lit(t) for t in TERMS])))
    by_doc = found.groupBy("doc_id", "text_key").agg(
        F.max(F.when(sure, F.struct("probability", "class"))).alias("best"), F.count_distinct("par").alias("n_notices"), F.max("probability").alias("p"))
    by_doc = by_doc.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "best", "n_notices", "p")
    out = docs.select("doc_id", "text_key").join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_key").eqNullSafe(F.col("t")), "left")
    return out.select("doc_id", F.when(F.col("n_notices").isNull(), NONE).otherwise(F.coalesce("best.class", F.lit(UNKNOWN))).alias("licence"),
                      F.coalesce("best.probability", "p", F.lit(0.0)).alias("probability"),
                      F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.col("best").isNotNull().alias("confirmed"))
