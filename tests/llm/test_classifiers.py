"""Toxicity and quality: held-out accuracy on the given tables, and odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.llm import quality, toxicity
from flowsieve.llm.labelled import id_remainder, training_rows

FOLDER = "/root/testdata/sf0.1"
ODD = [(1, None), (2, ""), (3, " .!? \n"), (None, "ein Satz."), (2, ""), (4, "wort " * 60_000), (5, "Ünï 日本! x")]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.fixture(scope="module")
def models(documents, labels):
    learnt = {"toxic": id_remainder(F.col("doc_id"), 5) != 0, "quality": id_remainder(F.col("doc_id"), 3) != 1}
    return {
        "toxic": (toxicity, toxicity.fit(documents, labels, learnt["toxic"])),
        "quality": (quality, quality.fit(documents, labels, learnt["quality"])),
    }


@pytest.mark.parametrize("label,modulus,held,accuracy,recall", [("toxic", 5, 0, 0.96, 0.75), ("quality", 3, 1, 0.93, 0.95)])
def test_held_out_accuracy(documents, labels, models, label, modulus, held, accuracy, recall):
    module, model = models[label]
    known = labels.filter(id_remainder(F.col("doc_id"), modulus) == held)
    found = module.score(documents.join(known.select("doc_id"), "doc_id"), model).select("doc_id", "score")
    table = found.join(known, "doc_id").toPandas()
    y, p = table[label].to_numpy() > 0, table["score"].to_numpy() >= 0.5
    assert ((p == y).mean() >= accuracy) and (p[y].mean() >= recall)
    assert p[~y].mean() <= 0.3


@pytest.mark.parametrize("label", ["toxic", "quality"])
def test_odd_rows_are_scored(spark, models, label):
    module, model = models[label]
    rows = [(i, t, "x", 0.5) for i, t in ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string, weights string, score double")
    found = module.score(df, model).collect()
    assert sorted(map(repr, (r.doc_id for r in found))) == sorted(repr(i) for i, _ in ODD)
    assert all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id == 2}) == 1
    assert module.score(df.limit(0), model).count() == 0


def test_offending_sentences_are_located(spark, models):
    clean = "Es ist gut. "
    df = spark.createDataFrame([(1, clean + "You stupid pathetic moron, trash! The end."), (2, clean)], "doc_id long, text string")
    found = {r.doc_id: r for r in toxicity.score(df, models["toxic"][1]).collect()}
    assert found[1].score >= 0.5 > found[2].score and not found[2].offending
    spans = [df.first().text[s.start : s.end] for s in found[1].offending]
    assert spans == ["You stupid pathetic moron, trash"]
    kept = toxicity.without_toxic(df.withColumn("score", F.lit("s")), models["toxic"][1]).collect()
    assert [tuple(r) for r in kept] == [(2, clean, "s")]


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_nothing_to_learn_from(spark, module, label):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1)], f"doc_id long, {label} int")
    one = spark.createDataFrame([(4, 1), (5, 1)], f"doc_id long, {label} int")
    for labels in (none, one):
        scores = [r.score for r in module.score(df, module.fit(df, labels, F.lit(True))).collect()]
        assert len(scores) == len(ODD) and np.isfinite(scores).all()


def test_training_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (3, 0), (None, 1)], "doc_id long, toxic int")
    rows = training_rows(df, labels, "toxic", F.lit(True)).collect()
    assert sorted((r.text or "", r.label) for r in rows) == [("", 0), ("a", 1), ("b", 1)]
    assert training_rows(df, labels, "toxic", F.lit(True), rows=1).select("label").distinct().count() == 1
