"""Licence notices in paragraphs, by a trained classifier and a comparison with templates.

A paragraph is a line of a text. Its features are word 2-grams and 3-grams, those that occur in any
template; a paragraph without one cannot be a notice. Multinomial logistic regression over the
families, over licence talk that names no family (`unknown`) and over ordinary text (`none`) is
fitted on variants of the templates and on a bounded sample of paragraphs of the input, and its
probabilities are calibrated by a temperature chosen on rows held out from the fit. A family is
confirmed when the paragraph shares enough n-grams with a template of that family, else the
paragraph is reported as `unknown`.

Everything that reads documents is DataFrame expressions evaluated row by row; there is no shuffle.

Cases: null and empty texts have no paragraphs; paragraphs are numbered by their line, from 0, blank
lines included; rows that repeat give their paragraphs each; with equal probabilities the first
family in the order of `FAMILIES` wins; a null id is kept with its paragraphs, and not learned from; texts are
read whole, whatever their length; an empty table gives no rows; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capture_analytics.llm.tables import documents, hash_sample, id_and_text, written

NONE, UNKNOWN = "none", "unknown"
# Documents whose lines serve as ordinary text in the fit.
BACKGROUND_DOCS = 400
# Share of a template's, or of the paragraph's, n-grams that confirms a family.
CONFIRM = 0.6
# Notices by which the families are known.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied.",
        "SPDX-License-Identifier: Apache-2.0"),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the "
        "LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause"),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
        "License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later"),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction",
        "SPDX-License-Identifier: MIT"),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0"),
    "public-domain": (
        "This work is in the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights "
        "to this work.",
        "SPDX-License-Identifier: CC0-1.0"),
    "reserved": (
        "All rights reserved.",
        "Copyright 2020 by the authors. All rights reserved.",
        "No part of this publication may be reproduced without prior written permission."),
}
# Licence talk without a family, and ordinary text with some of the same words.
GENERIC = (
    "Use is subject to license terms.", "Licensed under the terms of the license agreement.",
    "See the license file for details.", "This work is licensed under its own license.",
    "Released under the license of the project.", "Licensed under the license, version 1.",
    "This software is licensed under a commercial license.",
    "Redistribution is subject to the terms of the license.")
ORDINARY = (
    "The license of the driver was found in the car.", "This work is in progress.",
    "All of the rights of the people are in the book.", "Use of the road is free of charge.",
    "The terms of the work were set by the city.", "A copy of the letter was sent to the author.",
    "The public domain of the town is under the bridge.", "He was granted a license to fish.",
    "This program is on the air at eight.", "The version of the story that he told is free.",
    "Any person may obtain a copy at the door.", "Software of this kind is in use.")
FAMILIES = (*sorted(TEMPLATES), UNKNOWN, NONE)


def words_of(text: Column) -> Column:
    """Lower-case words, every number the word 0."""
    numbers = F.regexp_replace(F.lower(text), r"[0-9]+(\.[0-9]+)*", " 0 ")
    return F.filter(F.split(numbers, r"[^a-z0-9]+"), lambda w: w != "")


def grams(words: Column, n: int) -> Column:
    """Hashes of the word n-grams."""
    size = F.greatest(F.size(words) - (n - 1), F.lit(0))
    out = F.transform(F.slice(words, 1, size), lambda w: F.array(w))
    for k in range(1, n):
        out = F.zip_with(out, F.slice(words, k + 1, size), lambda a, w: F.concat(a, F.array(w)))
    return F.transform(out, lambda a: F.xxhash64(a))


def two_grams(words: Column) -> Column:
    size = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, size), F.slice(words, 2, size),
                      lambda a, b: F.xxhash64(F.array(a, b)))


def listed(values) -> str:
    """Numbers as the inside of an SQL list; one text is planned much faster than many columns."""
    return ", ".join(f"{v!r}D" if isinstance(v, float) else f"{v}L" for v in values)


def once(name: str) -> Column:
    """A column that keeps a later filter from being moved below the projection it stands in,
    where it would evaluate that projection's expressions again for each use."""
    return F.spark_partition_id().alias(name)


FAMILY_LIST = ", ".join(f"'{name}'" for name in FAMILIES)


class Model:
    """Vocabulary, weights and templates as plain numbers; `scored` turns them to expressions."""

    def __init__(self, pairs: list[int], triples: list[int], templates: list[tuple[str, list[int]]]):
        self.pairs, self.vocabulary = pairs, [*pairs, *triples]
        number = {g: i + 1 for i, g in enumerate(self.vocabulary)}
        self.templates = ", ".join(
            f"named_struct('family', '{name}', 'own', array({', '.join(str(number[g]) for g in own)}))"
            for name, own in templates)
        self.weights: list[list[float]] = []
        self.bias: list[float] = []
        self.temperature = 1.0

    def featured(self, rows: DataFrame) -> DataFrame:
        """Of rows with `paragraph`, those with a known 2-gram, with their `hits`: numbers of the
        known n-grams from 1, and the number `n_grams` of all distinct ones."""
        worded = rows.select("*", words_of(F.col("paragraph")).alias("words"), once("word_part"))
        pairs = worded.withColumn("pairs", two_grams(F.col("words"))).where(F.expr(
            f"exists(pairs, g -> g in ({listed(self.pairs)})) and word_part >= 0"))
        every = F.array_distinct(F.concat("pairs", grams(F.col("words"), 3)))
        known = F.expr(f"filter(grams, g -> g in ({listed(self.vocabulary)}))")
        table = F.expr(f"array({listed(self.vocabulary)})")
        return pairs.withColumn("grams", every).withColumn("n_grams", F.size("grams")).withColumn(
            "known", known).withColumn("hits", F.transform(
                "known", lambda g: F.array_position(table, g).cast("int"))).drop(
            "words", "pairs", "grams", "known", "word_part")

    def logits(self) -> Column:
        weights = listed([w for own in self.weights for w in own])
        size = len(self.vocabulary)
        return F.expr(f"""transform(sequence(0, {len(FAMILIES) - 1}), f -> aggregate(hits,
            element_at(array({listed(self.bias)}), f + 1),
            (s, i) -> s + element_at(array({weights}), f * {size} + i)))""")

    def likeness(self, condition: str) -> Column:
        """The largest share of n-grams in common with a template t for which the condition holds."""
        return F.expr(f"""coalesce(array_max(transform(filter(array({self.templates}),
            t -> {condition}), t -> size(array_intersect(hits, t.own))
            / double(least(size(t.own), n_grams)))), 0D)""")

    def scored(self, rows: DataFrame) -> DataFrame:
        """The rows that are not ordinary text, with predicted, probability, likeness, family."""
        out = self.featured(rows).withColumn("logits", self.logits()).select(
            "*", F.transform("logits", lambda x: x / self.temperature).alias("scaled"),
            once("score_part"))
        top = F.array_max("scaled")
        weight = F.aggregate("scaled", F.lit(0.0), lambda s, x: s + F.exp(x - top))
        out = out.withColumn("predicted", F.element_at(
            F.expr(f"array({FAMILY_LIST})"), F.array_position("scaled", top).cast("int"))).withColumn(
            "probability", 1 / weight)
        out = out.withColumn("likeness", self.likeness("t.family = predicted"))
        return out.withColumn("family", F.when(
            F.col("predicted").isin(NONE, UNKNOWN) | (F.col("likeness") >= CONFIRM),
            F.col("predicted")).otherwise(UNKNOWN)).where(
            (F.col("predicted") != NONE) & (F.col("score_part") >= 0)).drop(
            "logits", "scaled", "hits", "n_grams", "score_part")


def variants(notice: str) -> list[str]:
    """A notice as it is met: whole, cut at either end, and within other words."""
    words = notice.split()
    most = max(3, (3 * len(words) + 3) // 4)
    return list(dict.fromkeys([notice, notice.upper(), " ".join(words[:most]),
                               " ".join(words[-most:]), f"Note: {notice}", f"{notice} See below."]))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, line, paragraph of every line that is not blank."""
    return id_and_text(docs).select("doc_id", F.posexplode(F.split("text", "\n")).alias(
        "line", "paragraph")).where(F.trim("paragraph") != "")


def template_grams(spark: SparkSession) -> Model:
    """The templates' n-grams, computed by the same expressions as those of documents."""
    notices = [(name, text) for name, own in sorted(TEMPLATES.items()) for text in own]
    notices += [(UNKNOWN, text) for text in GENERIC]
    rows = spark.range(1).select(F.posexplode(F.array(*[
        F.struct(F.lit(n).alias("family"), F.lit(t).alias("text")) for n, t in notices])))
    words = words_of(F.col("col.text"))
    found = rows.select("pos", "col.family", F.array_distinct(two_grams(words)).alias("pairs"),
                        F.array_distinct(grams(words, 3)).alias("triples")).orderBy("pos").collect()
    pairs = sorted({g for r in found for g in r["pairs"]})
    triples = sorted({g for r in found for g in r["triples"]} - set(pairs))
    return Model(pairs, triples, [(r["family"], [*r["pairs"], *r["triples"]]) for r in found
                                  if r["family"] != UNKNOWN and r["pairs"]])


def fit(docs: DataFrame) -> Model:
    """Train on the notices' variants and on lines of BACKGROUND_DOCS documents of the input."""
    spark = docs.sparkSession
    model = template_grams(spark)
    marked = [(name, v) for name, own in sorted(TEMPLATES.items()) for t in own for v in variants(t)]
    marked += [(UNKNOWN, v) for t in GENERIC for v in variants(t)]
    marked += [(NONE, t) for t in ORDINARY]
    stated = spark.range(1).select(F.explode(F.array(*[F.struct(
        F.lit(n).alias("label"), F.lit(t).alias("paragraph")) for n, t in marked]))).select("col.*")
    ids = hash_sample(id_and_text(docs).select("doc_id").where("doc_id is not null"), "doc_id",
                      BACKGROUND_DOCS).select(F.col("doc_id").alias("picked"))
    sample = id_and_text(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("picked"), "left_semi")
    lines = model.featured(paragraphs(sample))
    ordinary = lines.where(model.likeness("true") < CONFIRM / 2).select(
        F.lit(NONE).alias("label"), "paragraph")
    rows = written(model.featured(stated.unionByName(ordinary)).select("label", "hits", "paragraph"))
    vector = array_to_vector(F.transform(
        F.sequence(F.lit(1), F.lit(len(model.vocabulary))),
        lambda i: F.array_contains("hits", i).cast("double")))
    index = F.array_position(F.expr(f"array({FAMILY_LIST})"), F.col("label")) - 1
    ready = rows.select("label", "hits", index.cast("double").alias("y"), vector.alias("x"),
                        (F.pmod(F.xxhash64("paragraph"), F.lit(5)) == 0).alias("held")).coalesce(1)
    fitted = LogisticRegression(
        featuresCol="x", labelCol="y", family="multinomial", maxIter=40, regParam=1e-3,
        standardization=False).fit(ready.where("not held").unionByName(
            # every class is seen, so the order of the classes is that of FAMILIES
            ready.where("held").dropDuplicates(["label"])).select("x", "y"))
    model.weights = fitted.coefficientMatrix.toArray().tolist()
    model.bias = [float(b) for b in fitted.interceptVector]
    # the temperature under which rows that were held out are most likely
    tried = [2.0 ** (k / 2) for k in range(-4, 7)]
    held = rows.where(F.pmod(F.xxhash64("paragraph"), F.lit(5)) == 0).select(
        index.cast("int").alias("y"), model.logits().alias("logits"))
    losses = held.select(*[F.sum(_loss(F.col("logits"), F.col("y"), t)).alias(f"t{i}")
                           for i, t in enumerate(tried)]).first()
    ranked = sorted((loss, abs(math.log(t)), t) for loss, t in zip(losses, tried) if loss is not None)
    model.temperature = ranked[0][2] if ranked else 1.0
    return model


def _loss(logits: Column, label: Column, temperature: float) -> Column:
    scaled = F.transform(logits, lambda x: x / temperature)
    top = F.array_max(scaled)
    return F.log(F.aggregate(scaled, F.lit(0.0), lambda s, x: s + F.exp(x - top))) + top - \
        F.element_at(scaled, label + 1)


def license_notices(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, line, predicted, probability, likeness, family of each paragraph that the model
    takes for a licence notice."""
    return model.scored(paragraphs(docs)).drop("paragraph")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return license_notices(docs, fit(docs))
