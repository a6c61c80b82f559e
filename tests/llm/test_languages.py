import random

import numpy as np
from pyspark.sql import functions as F

from flowsieve.llm import languages

SYLLABLES = {
    "aa": ["ta", "ko", "mi", "ra", "ne"],
    "bb": ["sch", "ung", "ein", "ver", "ich"],
    "cc": ["çõ", "lha", "ção", "nho", "ém"],
}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def corpus(rng, per_language=80):
    return [(i * 3 + k, text(rng, lang, rng.randint(3, 40)), lang) for i in range(per_language) for k, lang in enumerate(SYLLABLES)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, lettered string, score long")


def test_held_out_texts_and_mixtures(spark):
    rng = random.Random(1)
    docs = table(spark, corpus(rng))
    model = languages.fit(docs, F.col("doc_id") % 4 != 2)
    new = [(1000 + i * 3 + k, text(rng, lang, n), lang) for i in range(20) for n in (1, 10) for k, lang in enumerate(SYLLABLES)]
    rows = languages.predict(table(spark, new), model).collect()
    right = {(i, lang) for i, _, lang in new}
    assert np.mean([(r.doc_id, r.lang_pred) in right for r in rows]) > 0.97
    both = [(i, text(rng, "aa", 60) + " " + text(rng, "cc", 20), "aa") for i in range(10)]
    for r in languages.predict(table(spark, both), model).collect():
        assert r.languages == ["aa", "cc"] and 0.6 < r.score < 0.9 and abs(sum(r.proportions) - 1) < 1e-6


def test_edges(spark):
    rng = random.Random(2)
    docs = corpus(rng) + [(900, None, "aa"), (901, "untold", None), (902, "", "bb")]
    model = languages.fit(table(spark, docs), F.lit(True))
    assert model.languages == ["aa", "bb", "cc"]
    edges = [(1, None, "aa"), (2, "", "aa"), (3, "1234 !!", "aa"), (4, "日", "aa"), (None, "tako mira", "aa"), (5, "x", None)]
    edges += [(6, text(rng, "bb", 200_000), "bb"), (7, "tako", "x"), (7, "tako", "x")]
    rows = languages.predict(table(spark, edges), model).collect()
    assert len(rows) == len(edges)
    found = {r.doc_id: r for r in rows}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 and found[i].languages == [] for i in (1, 2, 3))
    assert all(found[i].lang_pred in model.languages for i in (4, 5, 6, 7, None))
    assert found[6].lang_pred == "bb" and found[6].languages == ["bb"]
    assert all(0 <= r.score <= 1 for r in rows)


def test_nothing_to_learn_from(spark):
    empty = table(spark, [])
    model = languages.fit(empty, F.lit(True))
    assert languages.predict(empty, model).collect() == []
    assert {r.lang_pred for r in languages.predict(table(spark, [(1, "tako", "aa")]), model).collect()} == {"und"}


def test_one_language(spark):
    model = languages.fit(table(spark, [(1, "tako mira", "aa")]), F.lit(True))
    row = languages.predict(table(spark, [(2, "other words", None)]), model).first()
    assert (row.lang_pred, row.score, row.languages) == ("aa", 1.0, ["aa"])


def test_proportions_raise_the_likelihood_as_plain_steps_do():
    """The same expectation and maximisation, written text by text."""
    rng = np.random.default_rng(0)
    sizes = np.array([30, 1, 200])
    likely = rng.random((231, 3)).astype(np.float32)
    weight = rng.integers(1, 5, 231).astype(np.float32)
    texts = languages._Texts(likely, weight, sizes)
    shares = np.array([0.5, 0.3, 0.2])
    found = texts.stepped(texts.stepped(np.repeat(shares[None], 3, 0)))
    first = 0
    for row, size in enumerate(sizes):
        p, w = likely[first : first + size].astype(float), weight[first : first + size].astype(float)
        first += size
        parts = shares
        for _ in range(2):
            r = parts * p / (parts * p).sum(1, keepdims=True)
            parts = (w[:, None] * r).sum(0) / w.sum()
        np.testing.assert_allclose(found[row], parts, rtol=1e-4)
    settled = languages.settled(texts, np.repeat(shares[None], 3, 0))
    assert (texts.log_likelihood(settled) >= texts.log_likelihood(np.repeat(shares[None], 3, 0)) - 1e-6).all()
    sets = languages.language_sets(texts, shares)
    assert (sets[1] > 0).sum() == 1 and np.allclose(sets.sum(1), 1)
