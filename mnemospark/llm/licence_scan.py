"""Licence scan: a trained classifier of paragraphs, confirmed by template comparison.

Paragraphs end at blank lines; their lines are joined, so wrapped notices read like unwrapped ones.  They are
read in windows of WINDOWS words that overlap by half: long ones for licence texts, short ones for
notices among other words.  A window's features are hashed words and word pairs; a multinomial logistic
regression gives each licence family, and the class unknown, a probability.  It is trained in numpy
on pieces of the templates below with words left out and foreign words around them, and for unknown on lines
of the scanned documents and on shuffled template words.  Probabilities are calibrated by one temperature
on held back pieces.  A prediction counts only if the window holds a whole template of that family, or
SHARED of its three-word shingles.  So windows without any template's shingle need not be scored.

Training is bounded: PIECES pieces of each template and SAMPLE_LINES lines of SAMPLE_DOCUMENTS
documents.  Scanning runs on the JVM: features are joined to a table of weights and summed.

Defined results: null and empty texts have no licence; a document has the set of the families of its
paragraphs; repeated rows are judged alike, rows with a null id and one text too; without documents the templates
alone train the model; an empty table gives no row.  Only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions.columns import computed

FEATURES = 2048
WINDOWS = (40, 14, 7)
WINDOW = WINDOWS[0]
PIECES = 24
SAMPLE_LINES = 1500
SAMPLE_DOCUMENTS = 200
PARAGRAPH_END = r"\n[\t\r ]*\n"
#: Shingles of a longer template that a window must hold.
SHARED = 4
#: Least calibrated probability of a family.
LEAST = 0.5
# Notices and characteristic sentences of licence families.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT",
        "Licensed under the MIT License. See LICENSE for details.", "under the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, with permission to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "This work is available under the Apache License 2.0.", "Apache License, Version 2.0", "under the Apache License",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only",
        "Licensed under the GNU General Public License, version 2.", "GNU General Public License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later", "GNU Lesser General Public License",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "GNU Affero General Public License",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.", "Released under the BSD license.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "BSD 3-Clause License", "under the BSD license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License, version 2.0.", "Mozilla Public License",
    ],
    "ISC": [
        "Released under the ISC License.", "SPDX-License-Identifier: ISC", "under the ISC license",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0",
        "Licensed under the Eclipse Public License, version 2.0.", "Eclipse Public License",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "Public domain": [
        "This is free and unencumbered software released into the public domain.", "This work has been dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0",
    ],
    "Proprietary": [
        "All rights reserved.", "Copyright. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the copyright holder.",
        "Confidential and proprietary. Unauthorized copying of this file is prohibited without a license.",
    ],
}
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *TEMPLATES]
#: Foreign words that surround pieces in training, and ordinary sentences that hold cues.
PLAIN = (
    "the driver showed her licence at the border", "a license plate was found near the river", "he asked for permission to leave early",
    "there is no warranty on used cars in this shop", "the copyright debate went on for many years in the house", "she was licensed to teach in three states",
    "goods were redistributed to the villages in spring", "they reserved a table and all rights to complain", "the public park is a domain of birds",
    "permission slips are due on monday morning", "a fishing license costs ten coins here", "the general spoke to the public about the version of events",
)


def words_of(text: str) -> list[str]:
    """The words of the JVM expression below, in Python (for training)."""
    out, word = [], []
    for c in text.lower():
        if c.isalnum():
            word.append(c)
        elif word:
            out.append("".join(word))
            word = []
    return [*out, "".join(word)] if word else out


def _hash(*parts: str) -> int:
    """The hash of Spark's xxhash64."""
    value = 42
    for part in parts:
        value = xxhash.xxh64_intdigest(part.encode(), value)
    return value - 2**64 if value >= 2**63 else value


def features_of(words: list[str]) -> list[int]:
    grams = [(w,) for w in words] + list(zip(words, words[1:]))
    return sorted({_hash(*g) % FEATURES for g in grams})


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # FEATURES x families
    bias: np.ndarray
    temperature: float


def train(lines: list[str], seed: int = 11) -> Model:
    """The classifier from the templates and lines that hold no licence."""
    random = np.random.default_rng(seed)
    foreign = np.array([w for line in [*lines, *PLAIN] for w in words_of(line)], object)

    def around(words: list[str]) -> list[str]:
        before, after = (list(random.choice(foreign, random.integers(0, 9))) for _ in range(2))
        return ([*before, *words, *after] if random.random() < 0.5 else words)[:WINDOW]

    samples: list[tuple[list[str], int]] = []
    for label, family in enumerate(FAMILIES):
        for template in TEMPLATES.get(family, []):
            words = words_of(template)
            for i in range(PIECES):
                first = 0 if i % 2 or len(words) < 9 else int(random.integers(0, len(words) - 7))
                part = [w for w in words[first : first + WINDOW] if random.random() > 0.08] or words
                samples.append((around(words if i == 0 else part), label))
                if i % 3 == 0:
                    mixed = list(random.permutation(words)[: int(random.integers(1, 1 + max(1, len(words) // 2)))])
                    samples.append(([*list(random.choice(foreign, 8)), *mixed][:WINDOW], 0))
    for line in [*lines, *PLAIN * 10]:
        samples.append((words_of(line)[:WINDOW], 0))
    found = [features_of(words) or [0] for words, _ in samples]
    target = np.array([label for _, label in samples])
    back = random.random(len(samples)) < 0.2
    weights, bias = _fitted([f for f, x in zip(found, back) if not x], target[~back])
    logits = _logits([f for f, x in zip(found, back) if x], weights, bias)
    fit = lambda t: -np.log(_softmax(logits / t)[np.arange(len(logits)), target[back]] + 1e-9).mean()
    temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=fit) if back.any() else 1.0
    return Model(weights, bias, temperature)


def _logits(found: list[list[int]], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    sizes = np.array([len(f) for f in found])
    sums = np.add.reduceat(weights[np.concatenate(found)], np.r_[0, np.cumsum(sizes)[:-1]], axis=0)
    return sums / np.sqrt(sizes)[:, None] + bias


def _fitted(found: list[list[int]], target: np.ndarray, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by gradient descent with momentum, on sparse rows."""
    kinds = len(FAMILIES)
    one = np.eye(kinds)[target]
    weights, bias = np.zeros((FEATURES, kinds)), np.zeros(kinds)
    speed_w, speed_b = np.zeros_like(weights), np.zeros_like(bias)
    flat, sizes = np.concatenate(found), np.array([len(f) for f in found])
    row = np.repeat(np.arange(len(found)), sizes)
    share = (1 / np.sqrt(sizes))[row]
    for _ in range(rounds):
        e = (_softmax(_logits(found, weights, bias)) - one) / len(found)
        change = np.stack([np.bincount(flat, share * e[row, k], FEATURES) for k in range(kinds)], 1)
        speed_w = 0.9 * speed_w - 4.0 * (change + 1e-5 * weights)
        speed_b = 0.9 * speed_b - 4.0 * e.sum(0)
        weights, bias = weights + speed_w, bias + speed_b
    return weights, bias


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit(documents: DataFrame) -> Model:
    """The model, with at most SAMPLE_LINES lines of the SAMPLE_DOCUMENTS texts of least hash, from paragraphs that
    share no shingle with a template.

    Hashes are chosen first: only lines of the chosen texts leave their tasks.
    """
    texts = documents.where(F.length("text").between(1, 20_000)).select(F.xxhash64("text").alias("h"), "text")
    chosen = texts.select("h").distinct().orderBy("h").limit(SAMPLE_DOCUMENTS)
    parts = texts.join(chosen, "h", "left_semi").select(F.explode(F.split("text", PARAGRAPH_END)).alias("part"))
    plain = computed(computed(parts, {"w": words(F.col("part"))}), {"near": F.arrays_overlap(triples("w"), known_triples())}).where("not near")
    lines = plain.select(F.explode(F.split("part", "\n")).alias("line")).where("line <> ''").select(F.substring("line", 1, 400).alias("line")).distinct()
    return train(sorted(r["line"] for r in lines.orderBy(F.xxhash64("line")).limit(SAMPLE_LINES).collect()))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def pairs_and_words(of: str) -> Column:
    one = F.transform(of, lambda w: F.pmod(F.xxhash64(w), F.lit(FEATURES)).cast("int"))
    at = F.when(F.size(of) > 1, F.sequence(F.lit(0), F.size(of) - 2)).otherwise(F.array().cast("array<int>"))
    two = F.transform(at, lambda i: F.pmod(F.xxhash64(F.get(F.col(of), i), F.get(F.col(of), i + 1)), F.lit(FEATURES)).cast("int"))
    return F.array_distinct(F.concat(one, two))


def triples(of: str) -> Column:
    last = F.greatest(F.size(of) - 3, F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(F.col(of), i + k) for k in range(3)))))


def template_triples() -> list[tuple[str, list[int]]]:
    found = []
    for family, templates in TEMPLATES.items():
        for template in templates:
            w = words_of(template)
            found.append((family, sorted({_hash(*w[i : i + 3]) for i in range(max(1, len(w) - 2))})))
    return found


def known_triples() -> Column:
    """The shingles of all templates."""
    return F.lit(np.array(sorted({h for _, s in template_triples() for h in s}), np.int64))


def weight_table(spark: SparkSession, model: Model) -> DataFrame:
    """(feature, v): the weights of each feature, by family."""
    scaled = (model.weights / model.temperature).astype(float).round(5)
    return spark.createDataFrame([(i, row) for i, row in enumerate(scaled.tolist())], "feature int, v array<double>")


def windows_of(rows: DataFrame) -> DataFrame:
    """(d, t, paragraph, start, w): the words of the windows that share a shingle with a template; start holds the
    window's size as well, and d and t name the document."""
    known = known_triples()
    split = rows.select("d", "t", F.posexplode(F.split("text", PARAGRAPH_END)).alias("paragraph", "part"))
    # Each word list and each list of shingles is worked out once: filters on them stay where they are.
    parts = computed(computed(split, {"w": words(F.col("part"))}).drop("part"), {"near": F.arrays_overlap(triples("w"), known)})
    parts = parts.where("near").select("d", "t", "paragraph", "w")

    def starts(size: int) -> Column:
        last = F.greatest(F.lit(0), F.size("w") - size // 2 - 1)
        return F.transform(F.sequence(F.lit(0), last, F.lit(size // 2)), lambda at: F.struct(at.alias("at"), F.lit(size).alias("size")))

    cut = parts.select("d", "t", "paragraph", "w", F.explode(F.concat(*(starts(size) for size in WINDOWS))).alias("start"))
    cut = computed(cut.withColumnRenamed("w", "all"), {"w": F.slice("all", F.col("start.at") + 1, F.col("start.size"))}).drop("all")
    # Only windows are shuffled, to drop those of repeated rows; whole paragraphs stay in their tasks.
    near = computed(cut, {"triples": triples("w")}).where(F.arrays_overlap("triples", known))
    return near.dropDuplicates(["d", "t", "paragraph", "start"])


def paragraphs(rows: DataFrame, model: Model) -> DataFrame:
    """(d, t, paragraph, start, family, probability) of each such window, from rows (d, t, text).

    Windows that hold enough of no template are unknown whatever the classifier says and are not scored; their
    probability is null.
    """
    known = F.array(*(F.struct(F.lit(f).alias("f"), F.lit(np.array(s, np.int64)).alias("s")) for f, s in template_triples()))
    held = F.filter(known, lambda t: F.size(F.array_intersect(t["s"], F.col("triples"))) >= F.least(F.size(t["s"]), F.lit(SHARED)))
    keys = ["d", "t", "paragraph", "start"]
    windows = computed(windows_of(rows), {"templates": F.array_distinct(F.transform(held, lambda t: t["f"]))}).drop("triples")
    features = computed(windows.where(F.size("templates") > 0), {"features": pairs_and_words("w")})
    exploded = features.select(*keys, "templates", F.size("features").alias("n"), F.explode("features").alias("feature"))
    bias = (model.bias / model.temperature).astype(float).round(5).tolist()
    # FEATURES rows of one number a family: the broadcast is bounded.
    sums = (
        exploded.join(F.broadcast(weight_table(rows.sparkSession, model)), "feature")
        .groupBy(*keys)
        .agg(F.first("templates").alias("templates"), F.first("n").alias("n"),
             *(F.sum(F.get("v", F.lit(f))).alias(f"z{f}") for f in range(len(bias))))
    )
    z = F.array(*(F.lit(b) + F.col(f"z{f}") / F.sqrt(F.col("n").cast("double")) for f, b in enumerate(bias)))
    scored = (
        sums.select(*keys, "templates", z.alias("z"))
        .withColumn("best", F.array_max("z"))
        .withColumn("probability", 1 / F.aggregate("z", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("best"))))
        .withColumn("family", F.get(F.array(*(F.lit(f) for f in FAMILIES)), F.array_position("z", F.col("best")).cast("int") - 1))
    )
    sure = (F.col("probability") >= LEAST) & F.array_contains("templates", F.col("family"))
    judged = scored.select(*keys, F.when(sure, F.col("family")).otherwise(F.lit(UNKNOWN)).alias("family"), "probability")
    rest = windows.where(F.size("templates") == 0).select(*keys, F.lit(UNKNOWN).alias("family"), F.lit(None).cast("double").alias("probability"))
    return judged.union(rest)


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, licences, n_paragraphs, n_unknown, probability) of each row: families found, windows of them, windows
    with a template's shingle but no family, and the highest probability of a family.

    Families share sentences: of windows that begin within half a long window of each other, only the family
    of the likeliest counts.
    """
    d = F.coalesce(documents["doc_id"].cast("long"), F.lit(-(2**63))).alias("d")
    rows = documents.select(documents["doc_id"].cast("long").alias("doc_id"), d, F.xxhash64(documents["text"]).alias("t"), documents["text"].alias("text"))
    is_known = F.col("family") != UNKNOWN
    known = F.when(is_known, F.struct("probability", "family"))
    about = Window.partitionBy("d", "t", "paragraph").orderBy("start.at").rangeBetween(-(WINDOW // 2), WINDOW // 2)
    windows = paragraphs(rows, fit(rows)).withColumn("best", F.max(known).over(about))
    windows = windows.withColumn("family", F.when(is_known & (F.col("family") != F.col("best.family")), F.lit(UNKNOWN)).otherwise(F.col("family")))
    found = windows.groupBy("d", "t").agg(
        F.array_sort(F.collect_set(F.when(is_known, F.col("family")))).alias("licences"),
        F.count(F.when(is_known, 1)).alias("n_paragraphs"),
        F.count(F.when(~is_known, 1)).alias("n_unknown"),
        F.max(F.when(is_known, F.col("probability"))).alias("probability"),
    )
    return rows.select("doc_id", "d", "t").join(found, ["d", "t"], "left").select(
        "doc_id",
        F.coalesce("licences", F.array().cast("array<string>")).alias("licences"),
        F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"),
        F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"),
        F.coalesce("probability", F.lit(0.0)).alias("probability"),
    )
