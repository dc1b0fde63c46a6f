"""Quality classifier, licence scan and source mixing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainshade.llm import licenses, mixing, quality
from texts import words


def graded_rows(n, seed):
    """Texts of three grades: repeated junk, good text with an insult, good text."""
    rng, out = random.Random(seed), []
    for i in range(n):
        g = i % 3
        text = words(seed * 10_000 + i, rng.randint(20, 120))
        if g == 0:
            text = " ".join(w + rng.choice(["###", "$$$"]) for w in text.split()) if i % 2 else "buy now " * rng.randint(20, 60)
        elif g == 1:
            text = text.replace(" ", " moron ", 1) + " scum"
        out.append((i, text, g))
    return out


@pytest.fixture(scope="module")
def model(spark):
    rows = graded_rows(600, 1)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    ratings = spark.createDataFrame([(d, g) for d, _, g in rows] + [(None, 1), (5, None), (10 ** 9, 0), (7, 99)], "doc_id long, grade int")
    return quality.fit(docs, ratings, 3, per_grade=150)


def test_held_out_accuracy(spark, model):
    rows = graded_rows(300, 2)
    docs = spark.createDataFrame([(d, t, g) for d, t, g in rows], "doc_id long, text string, grade int")
    got = quality.scored(docs, model, grade=2).select("grade", "_quality.*", quality.selected().alias("kept")).collect()
    assert np.mean([round(r["expected_grade"]) == r["grade"] for r in got]) > 0.95
    assert np.mean([r["kept"] == (r["grade"] == 2) for r in got]) > 0.97
    assert model.thresholds[0] < model.thresholds[1]


def test_scores_of_odd_rows(docs, empty, model):
    got = quality.scored(docs, model, 2, name="q")
    assert got.columns == [*docs.columns, "q"] and got.count() == docs.count()
    assert got.filter("q.tail_probability is null or q.tail_probability not between 0 and 1").count() == 0
    assert quality.scored(empty, model, 2, name="q").count() == 0
    # null and empty text are scored alike
    assert got.filter("doc_id in (40, 41)").select("q").distinct().count() == 1


def test_no_ratings_keep_everything(spark, docs):
    none = spark.createDataFrame([(1, 0)], "doc_id long, grade int")
    assert quality.fit(docs, none, 3) is None
    assert quality.scored(docs, None, 2, name="q").filter(quality.selected("q")).count() == docs.count()


def test_gradient_of_the_cumulative_link_model():
    # the fitted thresholds of a model without features give the shares of the grades
    grade = np.array([0] * 50 + [1] * 30 + [2] * 20)
    _, w, theta = quality._fit([[0]] * 100, grade, np.ones(100), 3, min_documents=200, steps=400)
    assert len(w) == 0 and np.allclose(1 / (1 + np.exp(-theta)), [0.5, 0.8], atol=0.01)


def test_licence_scan(spark, docs, empty):
    known = {"Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
             "This work is licensed under the GNU General Public License, version 3.": "gpl", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd"}
    plain = ["You need a driving licence to drive.", "The licensed shop was released from the contract.", "Public work under the bridge."]
    rows = [(i, words(i, 30) + "\n" + t + "\n" + words(i + 50, 20)) for i, t in enumerate([*known, *plain])] + [(90, None), (91, ""), (None, "Released under the MIT License.")]
    rows += [(100 + i, "\n".join(words(1000 + 10 * i + j, 15) for j in range(10))) for i in range(40)]
    lines = licenses.paragraphs(spark.createDataFrame(rows, "doc_id long, text string"))
    model = licenses.fit(spark, lines, rows=300)
    got = {(r["doc_id"], r["paragraph"]): r["family"] for r in licenses.scan(lines, model).filter("confirmed").collect()}
    want = {(i, t): f for i, (t, f) in enumerate(known.items())} | {(None, "Released under the MIT License."): "mit"}
    assert got == want
    assert licenses.scan(licenses.paragraphs(empty), model).count() == 0
    assert licenses.scan(licenses.paragraphs(docs), model).filter("confirmed").count() == 0


def test_raking_meets_its_targets(spark):
    rng = random.Random(4)
    cells = spark.createDataFrame([(s, g, t, rng.randint(1, 1000)) for s in "abc" for g in ("en", "de") for t in ("x", "y")], "source string, lang string, topic string, tokens long")
    share = lambda d: spark.createDataFrame(list(d.items()), "value string, share double")
    targets = {"source": share({"a": 0.5, "b": 0.3, "c": 0.2}), "lang": share({"en": 0.6, "de": 0.4}), "topic": share({"x": 0.25, "y": 0.75})}
    raked = mixing.rake(cells, targets, passes=30)
    for d, t in targets.items():
        got = {r[d]: r["w"] for r in raked.groupBy(d).agg(F.sum("weight").alias("w")).collect()}
        assert got == pytest.approx({r["value"]: r["share"] for r in t.collect()}, abs=1e-6)
    done = mixing.calibrated(raked, 0.3)
    total = cells.agg(F.sum("tokens")).first()[0]
    assert done.agg(F.sum(F.col("probability") * F.col("tokens"))).first()[0] == pytest.approx(0.3 * total)
    # a share that fills small cells wholly still gives the asked tokens
    full = mixing.calibrated(raked, 0.9)
    assert full.agg(F.max("probability")).first()[0] == 1.0 and full.agg(F.sum(F.col("probability") * F.col("tokens"))).first()[0] == pytest.approx(0.9 * total)


def test_mix_of_odd_rows(docs, empty):
    got = mixing.mix(docs, name="mixed")
    assert got.columns == [*docs.columns, "mixed"] and got.count() == docs.count()
    assert got.filter("mixed.sampled is null or mixed.probability not between 0 and 1").count() == 0
    assert got.filter("doc_id = 50").select("mixed.sampled").distinct().count() == 1
    assert mixing.mix(empty, name="mixed").count() == 0
    counted = {r["doc_id"]: r["n_tokens"] for r in got.filter("doc_id between 40 and 47").select("doc_id", "mixed.n_tokens").collect()}
    assert counted == {40: 0, 41: 0, 42: 0, 43: 1, 44: 7, 45: 1, 46: 1, 47: 1}
    # columns of the operators' own names come back as they were
    assert got.select("_tokens", "_version", "_quality", "_mix", "_cell", "_of", "_share").distinct().collect() == [(77, "v", 3, 4, "c", 6, 0.1)]
    with pytest.raises(ValueError):
        mixing.mix(docs)
    with pytest.raises(ValueError):
        quality.scored(docs, None, 2)
