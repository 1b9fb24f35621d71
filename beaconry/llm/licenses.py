"""Licence scan of paragraphs.

A multinomial logistic regression over hashed word 1- and 2-grams, made sparse by an L1 penalty, tells licence families
and ordinary text apart.  It is trained on variants of the notices below and on the corpus' own ordinary paragraphs, those
that share little with any notice: all of them with an even hash, which together weigh as much as ``negatives`` variants.
A prediction is confirmed by comparing the paragraph's words with the family's notices: ``CONFIRM`` of a notice's words make
it that family, from ``LIKE`` on it is ``unknown``, below it is no licence.  The least probability is calibrated on all
ordinary paragraphs with an odd hash, which training leaves out; at most ``false_share`` of them may pass.  Every paragraph
counts as often as it stands in the corpus, and no paragraph is left out of both.

Paragraphs are lines.  Everything is DataFrame functions and Spark's own feature and classification stages.

Edge cases: null and blank texts have no paragraph and no family.  Digits in versions are kept as words.  Rows that
repeat a ``doc_id`` each carry what was found under that id.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from beaconry.llm.common import stored

# Short notices of common licences, by family.
NOTICES = {
    "apache": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
               "This project is released under the Apache License 2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS"],
    "mit": ["Released under the MIT License", "This software is licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "SPDX-License-Identifier: MIT"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
            "Licensed under the GNU GPL version 2 or later", "Licensed under the GNU Lesser General Public License"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Licensed under the BSD 3-Clause License", "Released under the BSD 2-Clause License"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0"],
    "cc": ["Licensed under CC BY-NC 4.0", "Licensed under CC BY 4.0", "Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Released into the public domain under CC0 1.0"],
}
FAMILIES = ["none", *NOTICES]
FEATURES, VARIANTS, NEGATIVES, FALSE_SHARE, CONFIRM, LIKE = 1 << 13, 40, 2000, 0.001, 0.6, 0.25


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(tokens: Column) -> Column:
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(tokens, pairs)


def notices(spark: SparkSession) -> DataFrame:
    rows = [(family, k, text) for family, texts in NOTICES.items() for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, "family string, k int, notice string").select("family", "k", words(F.col("notice")).alias("notice"))


def _notice_words() -> dict[str, list[list[str]]]:
    return {family: [sorted(set(re.findall(r"[a-z0-9]+", t.lower()))) for t in texts] for family, texts in NOTICES.items()}


def confirmed(tokens: Column, family: Column) -> Column:
    """The largest share of a notice's words that the paragraph holds, among notices of the family."""
    held, found = F.array_distinct(tokens), F.lit(0.0)
    for name, lists in _notice_words().items():
        shares = [F.size(F.array_intersect(held, F.array(*map(F.lit, own)))) / F.lit(float(len(own))) for own in lists]
        found = F.when(family == name, F.greatest(F.lit(0.0), *shares)).otherwise(found)
    return found


def paragraphs(docs: DataFrame, even: bool = False) -> DataFrame:
    """``doc_id, at, odd, tokens`` of every line with words, ``odd`` by the line's hash; with ``even`` only those not odd."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", r"[\r\n]+")).alias("at", "line")).withColumn("odd", F.pmod(F.xxhash64("line"), F.lit(2)) == 1)
    lines = lines.filter(~F.col("odd")) if even else lines
    return lines.select("doc_id", "at", "odd", words(F.col("line")).alias("tokens")).filter(F.size("tokens") > 0)


def _variants(spark: SparkSession, variants: int) -> DataFrame:
    """Notices with some words left out: the n-th variant of a notice leaves out about one word in ten."""
    many = notices(spark).withColumn("v", F.explode(F.sequence(F.lit(1), F.lit(variants))))
    left = F.filter("notice", lambda w, i: (F.col("v") == 1) | (F.pmod(F.xxhash64(w, i, F.col("v")), F.lit(10)) > 0))
    return many.select("family", left.alias("tokens"))


class LicenceModel:
    """``most`` is the largest probability of no licence that a reported line may have."""

    def __init__(self, weights, hashing: HashingTF, most: float):
        self.weights, self.hashing, self.most = weights, hashing, most

    def probabilities(self, lines: DataFrame) -> DataFrame:
        """``lines`` with ``p``, the probability of each of FAMILIES."""
        terms = lines.withColumn("terms_", grams(F.col("tokens")))
        return (self.weights.transform(self.hashing.transform(terms)).withColumn("p", vector_to_array("probability_"))
                .drop("terms_", "features_", "probability_", "raw_", "prediction_"))


def ordinary() -> Column:
    """Whether a line's ``tokens`` share little with every notice."""
    vocabulary = sorted({w for lists in _notice_words().values() for own in lists for w in own})
    held = F.array_intersect("tokens", F.array(*map(F.lit, vocabulary)))
    # The lines' words are compared once; each notice with the few that are left.
    return F.transform(F.array(held), lambda few: F.greatest(*[confirmed(few, F.lit(name)) for name in NOTICES]) < 0.4)[0]


def train(docs: DataFrame, variants: int = VARIANTS, negatives: int = NEGATIVES) -> LicenceModel:
    """A model of all ordinary lines with an even hash, without a threshold of its own."""
    spark = docs.sparkSession
    hashing = HashingTF(inputCol="terms_", outputCol="features_", numFeatures=FEATURES, binary=True)
    index = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")) - 1
    plain = paragraphs(docs, even=True).filter(ordinary()).select(F.lit("none").alias("family"), "tokens")

    def ready(rows: DataFrame) -> DataFrame:
        return hashing.transform(rows.select(index.cast("double").alias("label"), grams(F.col("tokens")).alias("terms_"))).select("label", "features_")

    features = stored(ready(plain), "license-lines")
    weight = min(1.0, negatives / max(1, features.count()))
    rows = features.withColumn("weight_", F.lit(weight)).union(ready(_variants(spark, variants)).withColumn("weight_", F.lit(1.0)))
    logistic = LogisticRegression(featuresCol="features_", labelCol="label", predictionCol="prediction_", probabilityCol="probability_", rawPredictionCol="raw_",
                                  weightCol="weight_", family="multinomial", regParam=0.002, elasticNetParam=0.9, maxIter=20, standardization=False)
    return LicenceModel(logistic.fit(rows), hashing, 0.5)


def likely(docs: DataFrame, model: LicenceModel) -> tuple[DataFrame, int]:
    """The lines that are a licence with probability 0.5 or more, stored, and how many lines the threshold is calibrated on.

    ``kept`` marks lines of the latter kind, ordinary ones with an odd hash.
    """
    seen = Observation()
    lines = paragraphs(docs).withColumn("kept", F.col("odd") & ordinary()).observe(seen, F.count_if("kept").alias("n"))
    found = stored(model.probabilities(lines).filter(F.col("p")[0] <= 0.5).drop("odd"), "license-likely")
    return found, seen.get["n"]


def calibrate(model: LicenceModel, found: DataFrame, n_kept: int, false_share: float = FALSE_SHARE) -> LicenceModel:
    """Sets the threshold so that at most ``false_share`` of the kept lines pass.

    Lines are counted by the logarithm of their probability of no licence, in steps of a thousandth, so the counts are bounded.
    """
    step = F.floor(-1000 * F.log(F.greatest(F.col("p")[0], F.lit(1e-300))))
    counts = found.filter("kept").groupBy(step.alias("step")).agg(F.count("*").alias("n"))
    passed = counts.withColumn("passed", F.sum("n").over(Window.orderBy(F.desc("step"))))
    edge = passed.filter(F.col("passed") > int(false_share * n_kept)).agg(F.max("step").alias("step")).first().step
    model.most = 0.5 if edge is None else min(0.5, math.exp(-(edge + 1) / 1000))
    return model


def fit(docs: DataFrame, variants: int = VARIANTS, negatives: int = NEGATIVES, false_share: float = FALSE_SHARE) -> LicenceModel:
    model = train(docs, variants, negatives)
    return calibrate(model, *likely(docs, model), false_share)


def _named(found: DataFrame, model: LicenceModel) -> DataFrame:
    best = F.array_max(F.slice("p", 2, len(FAMILIES) - 1))
    scored = found.filter(F.col("p")[0] <= model.most)
    named = scored.withColumn("guess", F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position("p", best).cast("int"))).withColumn("probability", 1 - F.col("p")[0])
    return (named.withColumn("overlap", confirmed(F.col("tokens"), F.col("guess")))
            .filter(F.col("overlap") >= LIKE).select("doc_id", "at", F.when(F.col("overlap") >= CONFIRM, F.col("guess")).otherwise("unknown").alias("family"), "probability", "overlap"))


def scan_lines(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """Lines that look like a licence: ``doc_id, at, family, probability, overlap``; family may be ``unknown``.

    Without a model one is fitted to ``docs``, whose lines are then scored once for the threshold and the result.
    """
    if model:
        return _named(model.probabilities(paragraphs(docs)), model)
    model = train(docs)
    found, n_kept = likely(docs, model)
    return _named(found, calibrate(model, found, n_kept))


def scan(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id, families, n_lines, probability``: families in order, joined by a bar; empty if none."""
    found = scan_lines(docs, model)
    per = found.groupBy(F.col("doc_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("family")), "|").alias("families"), F.count("*").alias("n_lines"), F.max("probability").alias("probability"))
    ids = docs.select("doc_id")
    return (ids.join(per, ids["doc_id"].eqNullSafe(per["id"]), "left")
            .select("doc_id", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("probability", F.lit(0.0)).alias("probability")))
