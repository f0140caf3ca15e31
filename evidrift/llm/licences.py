"""Licence scans with a trained paragraph classifier.

A paragraph is a run of lines with letters or digits, up to a line without any; it is read as a whole, so that wrapped notices count, and line by line. What has over
WINDOW words is read in windows of WINDOW words, half of them shared with the next. A paragraph has as many notices of a family as the better of both readings. Features are
hashed word n-grams (one and two words of letters and digits, lower-cased). A multinomial logistic regression with an elastic net, so that its weights are sparse, tells the licence
families of TEMPLATES, whole and in fragments, from an unknown class, learnt from at most UNKNOWN windows of distinct whole lines of the corpus (lowest
hashes, half of them of lines with a word in common with the templates) that hardly overlap any template. The family's probability must exceed a bar set on held-out unknown windows, so that at most one in a thousand of these passes: none, where they are fewer.
A prediction counts only if the paragraph holds at least CONFIRM of the word pairs of a template of that family.

Defined results: null, empty and blank texts have no paragraph and no notice; rows that repeat a doc_id are scanned each;
null ids are kept; other columns, whatever their names, are ignored; an empty table gives no rows. Texts may be of any length, as windows bound a row. The rows are stored once with their numbers and the few
paragraphs that a template could confirm.

Plan: DataFrame operators and Spark's own ML stages, all in the JVM. A confirmed paragraph has one of the templates' anchor words, as fewer pairs than a
confirmation takes are without any; texts and lines without one are passed over first, which changes no result. One narrow pass; what is shuffled is the few confirmed notices,
summed by row. The model's size is fixed.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, stored

WINDOW, UNKNOWN, FEATURES, CONFIRM = 64, 4000, 1 << 13, 0.6
_UNKNOWN = "unknown"
_BREAK = r"\n(?:[^\p{L}\p{N}\n]*+\n)++"

# Usual notices of public licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD", "Use of this source code is governed by a BSD-style license."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("proprietary", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission."),
]


# Words too common to anchor a notice.
_COMMON = {"a", "all", "and", "any", "are", "as", "be", "by", "for", "in", "into", "is", "it", "no", "of", "on", "or", "the", "this", "to", "under", "use", "with", "without", "you", "your", "work", "free"}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _pairs(words: Column) -> Column:
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(words)


def _windows(words: Column, size: int, step: int) -> Column:
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(step)), lambda s: (s == 1) | (s + (size - step) <= F.size(words)))
    return F.when(F.size(words) <= size, F.array(words)).otherwise(F.transform(starts, lambda s: F.slice(words, s, F.lit(size))))


def anchors() -> list[str]:
    """Words of which every confirmed paragraph has one: for each template the words that cover the most of its pairs, until
    fewer pairs are left than a confirmation takes."""
    out: set[str] = set()
    for _, notice in TEMPLATES:
        words = [w for w in re.split(r"[\W_]+", notice.lower()) if w]
        left = total = set(zip(words, words[1:]))
        while len(left) >= CONFIRM * len(total):
            word = max({w for p in left for w in p}, key=lambda w: (w not in _COMMON, w in out, sum(w in p for p in left) * (len(w) > 2), len(w), w))
            out.add(word)
            left = {p for p in left if word not in p}
    return sorted(out)


def _anchored(text: Column) -> Column:
    return F.lower(text).rlike(f"(?:{'|'.join(anchors())})(?![\\p{{L}}\\p{{N}}])")


def _paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, _BREAK), lambda x: x.rlike(r"[\p{L}\p{N}]"))


def _windowed(lines: DataFrame) -> DataFrame:
    """lines with words in place of text: a row for every window that has a word."""
    rest = [c for c in lines.columns if c != "text"]
    return lines.select(*rest, _words(F.col("text")).alias("w")).where(F.size("w") > 0).select(*rest, F.explode(_windows(F.col("w"), WINDOW, WINDOW // 2)).alias("words"))


def _anchored_paragraphs(text: Column) -> Column:
    """number and text of the paragraphs that a template could confirm."""
    numbered = F.transform(_paragraphs(text), lambda x, i: F.struct(i.alias("paragraph"), x.alias("text")))
    return F.when(_anchored(text), F.filter(numbered, lambda x: _anchored(x["text"])))


def paragraphs(rows: DataFrame) -> DataFrame:
    """rows: row_no, own (numbered paragraphs). row_no, paragraph, whole (whether it is read as a whole) and words of every window that a template could confirm."""
    own = rows.select("row_no", F.explode("own").alias("p")).select("row_no", "p.*")
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("text")))
    whole = F.array(F.struct(F.lit(True).alias("whole"), F.col("text").alias("text")))
    read = own.select("row_no", "paragraph", F.explode(F.when(F.size(lines) > 1, F.concat(whole, lines)).otherwise(lines)).alias("r")).select("row_no", "paragraph", "r.*")
    return _windowed(read.where(_anchored(F.col("text"))))


def sample(docs: DataFrame, unknown: int) -> DataFrame:
    """words of at most unknown windows of distinct whole lines, half of them of lines with an anchor. A line is shuffled as its hash."""
    lines = docs.select(F.explode(F.split(F.col("text").cast("string"), "\n")).alias("text")).select(F.xxhash64("text").alias("h"), "text")
    hashes = stored(lines.select("h", _anchored(F.col("text")).alias("near")).distinct())
    near = hashes.where("near").orderBy("h").limit(unknown // 2)
    chosen = near.unionAll(hashes.select("h", F.lit(False).alias("near")).orderBy("h").limit(unknown // 2))
    texts = lines.join(F.broadcast(chosen.select("h").distinct()), "h").groupBy("h").agg(F.min("text").alias("text"))
    windows = stored(_windowed(texts.join(F.broadcast(chosen), "h")).select("near", "words"))
    halves = [windows.where(F.col("near") == x).orderBy(F.xxhash64("words"), "words").limit(unknown // 2) for x in (True, False)]
    out = stored(halves[0].unionAll(halves[1]).select("words"))
    forget(hashes)
    forget(windows)
    return out


def templates(spark) -> DataFrame:
    out = spark.createDataFrame(TEMPLATES, "family string, notice string").withColumn("words", _words(F.col("notice")))
    return out.select("family", "words", _pairs(F.col("words")).alias("pairs"))


def _featured(rows: DataFrame) -> DataFrame:
    return HashingTF(inputCol="terms", outputCol="features", numFeatures=FEATURES).transform(rows.withColumn("terms", F.concat("words", _pairs(F.col("words")))))


class Classifier:
    def __init__(self, model, families: list[str], bar: float):
        self.model, self.families, self.bar = model, families, bar

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with family and probability of the likeliest family, where it exceeds the bar."""
        scored = self.model.setPredictionCol("label").setProbabilityCol("p").setRawPredictionCol("").transform(_featured(rows))
        scored = scored.withColumn("family", F.element_at(F.array(*map(F.lit, self.families)), F.col("label").cast("int") + 1))
        return scored.withColumn("probability", F.array_max(vector_to_array("p"))).drop("terms", "features", "p", "label").where((F.col("family") != _UNKNOWN) & (F.col("probability") >= self.bar))


def train(docs: DataFrame, unknown: int = UNKNOWN) -> Classifier:
    spark = docs.sparkSession
    known = templates(spark)
    families = [_UNKNOWN, *sorted({f for f, _ in TEMPLATES})]
    held = known.select("pairs").collect()
    some = sample(docs, unknown)
    overlap = F.greatest(*[F.size(F.array_intersect(_pairs(F.col("words")), F.array(*map(F.lit, r.pairs)))) / F.lit(float(len(r.pairs))) for r in held])
    some = stored(some.where(overlap < 0.3).select("words", F.lit(_UNKNOWN).alias("family"), (F.pmod(F.xxhash64("words", F.lit(1)), F.lit(5)) == 0).alias("held")))
    pieces = F.array_union(F.array("words"), F.array_union(_windows(F.col("words"), 8, 4), _windows(F.col("words"), 16, 8)))
    notices = known.select("family", F.explode(pieces).alias("words")).where(F.size("words") > 3)
    rows = some.where("not held").select("words", "family").unionAll(notices.select("words", "family"))
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    rows = _featured(rows).withColumn("label", label).withColumn("weight", F.when(F.col("family") == _UNKNOWN, 1.0).otherwise(5.0)).select("label", "weight", "features").coalesce(2)
    fit = LogisticRegression(maxIter=60, regParam=2e-4, elasticNetParam=0.5, weightCol="weight", family="multinomial", standardization=False, aggregationDepth=2).fit(rows)
    out = Classifier(fit, families, 0.0)
    held_out = some.where("held").select("words")
    pass_over = held_out.count() // 1000
    best = [r.probability for r in out.predict(held_out).orderBy(F.desc("probability")).limit(pass_over + 1).collect()]
    out.bar = max(0.5, math.nextafter(best[pass_over], 2) if len(best) > pass_over else 0.0)
    forget(some)
    return out


def scan(docs: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """row_no, doc_id, n_paragraphs, families (sorted, comma-joined) and n_notices of every row of docs."""
    classifier = classifier or train(docs)
    text = F.col("text").cast("string")
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", F.coalesce(F.size(_paragraphs(text)), F.lit(0)).alias("n_paragraphs"), _anchored_paragraphs(text).alias("own")))
    found = classifier.predict(paragraphs(rows))
    against = templates(docs.sparkSession).groupBy("family").agg(F.collect_list("pairs").alias("known"))
    own = _pairs(F.col("words"))
    confirmed = F.exists("known", lambda t: F.size(F.array_intersect(t, own)) >= F.size(F.array_distinct(t)) * F.lit(CONFIRM))
    found = found.join(F.broadcast(against), "family").where(confirmed)
    found = found.groupBy("row_no", "paragraph", "family").agg(F.greatest(F.count_if("whole"), F.count_if(~F.col("whole"))).alias("n"))
    found = found.groupBy("row_no").agg(F.concat_ws(",", F.array_sort(F.collect_set("family"))).alias("families"), F.sum("n").alias("n_notices"))
    return rows.drop("own").join(found, "row_no", "left").select("row_no", "doc_id", "n_paragraphs", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_notices", F.lit(0)).alias("n_notices"))
