"""Licence scans: a paragraph classifier over word n-grams, an own class for the unknown, and templates that confirm.

A sparse multinomial logistic regression over the words and word pairs of a line names the licence family; a second, one-variable
regression on held-out rows turns its certainty into a calibrated probability that the line is a licence at all; and a line counts
as confirmed only if it holds most words of some template of the family. Everything runs as DataFrame and Spark ML steps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rainshade.llm.common import stored

UNKNOWN = "unknown"
BACKGROUND = 3000
VOCABULARY = 1 << 13
COVERED = 0.7

# Names of licences and sentences of their published texts.
NAMES = {
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache Software License"],
    "mit": ["MIT License", "MIT licence", "MIT", "Expat License"],
    "bsd": ["BSD License", "3-Clause BSD License", "BSD 2-Clause License", "BSD-3-Clause"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License, version 2", "GPL-3.0", "GNU GPL v2 or later"],
    "lgpl": ["GNU Lesser General Public License", "LGPL-2.1", "GNU LGPL, version 3"],
    "agpl": ["GNU Affero General Public License", "AGPL-3.0", "GNU AGPL, version 3"],
    "mpl": ["Mozilla Public License, v. 2.0", "MPL-2.0", "Mozilla Public License Version 2.0"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-3.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0"],
    "public-domain": ["CC0 1.0 Universal", "the public domain", "the Unlicense", "CC0-1.0"],
}
FRAMES = ["Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "This file is distributed under the terms of the {}.",
          "The source code is available under the {}.", "License: {}", "SPDX-License-Identifier: {}"]
SENTENCES = {
    "apache": ["you may not use this file except in compliance with the License. You may obtain a copy of the License at",
               "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "You should have received a copy of the GNU General Public License along with this program."],
    "lgpl": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file"],
    "cc-by": ["You are free to share and adapt the material for any purpose as long as you give appropriate credit"],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
}
# licence-like sentences of no known family
STRANGE = ["house rules", "terms of our partners", "customer agreement", "site policy", "Example Works License", "old agreement between the parties", "driving licence of the owner",
           "hunting license of the county", "usual conditions", "contract signed last year", "Northern Data License", "Model Terms 7.1"]
PROSE = ["A valid license is required to drive a car.", "The permission of the owner was granted free of charge.", "All rights reserved.", "The software was released last year.",
         "This work is hard.", "The public was not permitted to use the source.", "Copyright law applies.", "Version 2.0 of the file is available.", "The terms of the agreement are public."]


def templates() -> list[tuple[str, str]]:
    """(family, text): every frame with every name of a family, and the family's sentences."""
    framed = [(f, frame.format(n)) for f, names in NAMES.items() for n in names for frame in FRAMES]
    return framed + [(f, s) for f, texts in SENTENCES.items() for s in texts]


def pieces(text: str, size: int = 12, step: int = 3) -> list[str]:
    """Runs of `size` words of a longer sentence, as licence texts come wrapped and cut."""
    words = text.split()
    return [" ".join(words[i:i + size]) for i in range(0, max(1, len(words) - size + step), step)] if len(words) > size else []


def tokens(text: Column) -> Column:
    """Lower-case words; digits, points, signs and hyphens inside a word stay, as in 2.0 or by-nc."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}.+-]+|[.]+(?=\\s|$)"), lambda w: w != "")


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph_no, paragraph) per line of a text that is not blank; null text has none."""
    return (docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.posexplode(F.split(F.col(f"`{text_col}`").cast("string"), "\n")).alias("paragraph_no", "paragraph"))
            .filter(F.trim("paragraph") != ""))


@dataclass
class LicenceModel:
    grams: PipelineModel
    families: list[str]
    classifier: LogisticRegressionModel
    calibration: LogisticRegressionModel


def _grams(rows: DataFrame, pairs: NGram) -> DataFrame:
    """rows with `_grams`, the words and word pairs of the paragraph."""
    return pairs.transform(rows.withColumn("_words", tokens(F.col("paragraph")))).withColumn("_grams", F.concat("_words", "_pairs"))


def _certainty(probability: Column, unknown: int) -> Column:
    """Log odds of any known family, as a one-element vector."""
    from pyspark.ml.functions import array_to_vector
    known = F.greatest(F.least(1 - F.element_at(probability, unknown + 1), F.lit(1 - 1e-9)), F.lit(1e-9))
    return array_to_vector(F.array(F.log(known / (1 - known))))


def fit(spark: SparkSession, background: DataFrame, rows: int = BACKGROUND) -> LicenceModel:
    """Fit on the templates, strange licences, and at most `rows` lines of the background: of each remainder of their hash the least.

    Lines that speak of licences or copyright are no background. A quarter of all rows, by hash, only calibrates.
    """
    lower = F.lower("paragraph")
    silent = ~(F.contains(lower, F.lit("licen")) | F.contains(lower, F.lit("copyright")) | F.contains(lower, F.lit("warrant")) | F.contains(lower, F.lit("permission")))
    hashed = background.select("paragraph").filter(silent).withColumn("_hash", F.xxhash64("paragraph"))
    # one line for each of `rows` remainders of the hash: a sum per task, no sort of all lines
    firsts = hashed.groupBy(F.pmod("_hash", F.lit(rows)).alias("_no")).agg(F.min("_hash").alias("_first"))
    plain = hashed.join(F.broadcast(firsts), F.col("_hash") == F.col("_first")).select(F.lit(UNKNOWN).alias("family"), "paragraph").distinct()
    known = templates()
    strange = [(UNKNOWN, frame.format(n)) for n in STRANGE for frame in FRAMES] + [(UNKNOWN, s) for s in PROSE]
    made = spark.createDataFrame([*known, *[(f, x) for f, t in known for x in (t[:-1], *pieces(t))], *strange], "family string, paragraph string")
    families = [UNKNOWN, *NAMES]
    pairs = NGram(n=2, inputCol="_words", outputCol="_pairs")
    number = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    data = stored(_grams(plain.unionByName(made), pairs).select("paragraph", "_grams", number.cast("double").alias("label"),
                                                                 (F.pmod(F.xxhash64("paragraph"), F.lit(4)) == 0).alias("held_out")))
    vectors = CountVectorizer(inputCol="_grams", outputCol="_features", vocabSize=VOCABULARY, minDF=2.0, binary=True).fit(data.filter("not held_out"))
    ready = vectors.transform(data)
    classifier = LogisticRegression(featuresCol="_features", labelCol="label", family="multinomial", regParam=0.002, elasticNetParam=0.5, maxIter=60,
                                    probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_family").fit(ready.filter("not held_out"))
    held = classifier.transform(ready.filter("held_out")).select(_certainty(vector_to_array("_probability"), 0).alias("_certainty"), (F.col("label") > 0).cast("double").alias("label"))
    calibration = LogisticRegression(featuresCol="_certainty", labelCol="label", regParam=0.01, maxIter=50, probabilityCol="_known", rawPredictionCol="_known_raw", predictionCol="_is_known").fit(held)
    return LicenceModel(PipelineModel([pairs, vectors]), families, classifier, calibration)


def scan(lines: DataFrame, model: LicenceModel, covered: float = COVERED) -> DataFrame:
    """Lines of a likely known family: doc_id, paragraph_no, paragraph, family, probability, similarity, confirmed.

    probability is the calibrated one of any known family (0.5 and more is likely); similarity is the largest share of a template's
    words that the line holds, over the family's templates; a line is confirmed at `covered` or more. Lines of any length are read
    whole; repeated rows are scanned each by itself; null ids are passed through; an empty table gives no rows.
    """
    pairs, vectors = model.grams.stages
    guessed = model.classifier.transform(vectors.transform(_grams(lines, pairs)))
    shares = vector_to_array("_probability")
    known = F.slice(shares, 2, len(model.families) - 1)
    named = guessed.select(*lines.columns, "_words", F.element_at(F.array(*map(F.lit, model.families[1:])), F.array_position(known, F.array_max(known)).cast("int")).alias("family"),
                           _certainty(shares, 0).alias("_certainty"))
    likely = (model.calibration.transform(named).withColumn("probability", F.element_at(vector_to_array("_known"), 2)).filter("probability >= 0.5"))
    by_family: dict[str, list[str]] = {}
    for f, t in templates():
        by_family.setdefault(f, []).append(t)
    of = F.create_map(*[x for f, texts in by_family.items() for x in (F.lit(f), F.array(*[F.lit(t) for t in texts]))])

    def held(t: Column) -> Column:
        words = F.array_distinct(tokens(t))
        return F.size(F.array_intersect(words, F.col("_words"))) / F.size(words)

    similarity = F.array_max(F.transform(of[F.col("family")], held))
    return likely.withColumn("similarity", similarity).select(*lines.columns, "family", "probability", "similarity", (F.col("similarity") >= covered).alias("confirmed"))
