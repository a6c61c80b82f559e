"""The two classifiers against the same steps written plainly, document by document."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowsieve.llm import quality, toxicity
from flowsieve.llm.labelled import training_rows
from flowsieve.llm.textbytes import text_chunks

WORDS = ["the", "river", "house", "green", "walks", "slowly", "and", "sings", "table", "window"]
MARKED = ["moronic", "idiots", "stupidly", "trashy"]


def corpus(rng, n=60):
    rows = []
    for i in range(n):
        y = i % 2
        sentences = [" ".join(rng.choices(WORDS, k=rng.randint(3, 8))) for _ in range(rng.randint(1, 5))]
        if y:
            sentences.insert(rng.randrange(len(sentences) + 1), " ".join(rng.choices(MARKED, k=2) + rng.choices(WORDS, k=2)))
        rows.append((i, ". ".join(sentences) + ".", y))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus(random.Random(4))
    documents = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1, rows[1][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return documents, labels


def trained(tables, label):
    """The training rows in the order of their number; the repeated one weighs two."""
    rows = training_rows(*tables, label, F.lit(True)).orderBy("row").collect()
    assert sorted({r.weight for r in rows}) == [1, 2] and {r.block for r in rows} == {0}
    return rows


def chunk_of(text):
    return next(iter(text_chunks(pa.array([text]))))


def test_quality(spark, tables):
    rows = trained(tables, "quality")
    features = [quality._features(chunk_of(r.text))[1] for r in rows]
    counts = {0: {}, 1: {}}
    for r, found in zip(rows, features):
        for f in found:
            counts[r.label][f] = counts[r.label].get(f, 0) + r.weight
    size = 1 << quality.BITS
    totals = {y: sum(c.values()) + size * quality.SMOOTHING for y, c in counts.items()}

    def ratio(f):
        a, b = (counts[y].get(f, 0) + quality.SMOOTHING for y in (1, 0))
        return 0.0 if a + b <= 2 * quality.SMOOTHING else math.log(a / totals[1]) - math.log(b / totals[0])

    vectors = []
    for found in features:
        x = {f: ratio(f) for f in found}
        length = max(math.sqrt(sum(v * v for v in x.values())), 1e-9)
        vectors.append({f: v / length for f, v in x.items()})
    w, b, alpha = {}, 0.0, [0.0] * len(rows)
    for _ in range(quality.ROUNDS):
        order = np.random.default_rng(0)
        for _ in range(quality.EPOCHS):
            for i in order.permutation(len(rows)):
                y, x = (1.0 if rows[i].label else -1.0), vectors[i]
                gradient = y * (sum(w.get(f, 0.0) * v for f, v in x.items()) + b) - 1.0
                step = gradient / (sum(v * v for v in x.values()) + 1.0)
                new = min(max(alpha[i] - step, 0.0), quality.COST * rows[i].weight)
                for f, v in x.items():
                    w[f] = w.get(f, 0.0) + (new - alpha[i]) * y * v
                b += (new - alpha[i]) * y
                alpha[i] = new
    model = quality.fit(*tables, F.lit(True))
    found = {r.doc_id: r.score for r in quality.score(tables[0], model).collect()}
    for r, x in zip(rows, vectors):
        margin = sum(w.get(f, 0.0) * v for f, v in x.items()) + b
        doc_id = next(d.doc_id for d in tables[0].collect() if d.text == r.text)
        assert found[doc_id] == pytest.approx(1 / (1 + math.exp(-quality.STEEPNESS * margin)), abs=1e-3)


def sentences(text):
    """Features of each sentence."""
    s = toxicity._sentences(chunk_of(text))
    return [s.feature[s.sentence == k].tolist() for k in range(len(s.text))]


def test_toxicity(spark, tables):
    rows = trained(tables, "toxic")
    bags = [sentences(r.text) for r in rows]
    seen = {0: {}, 1: {}}
    n = {y: sum(r.weight for r in rows if r.label == y) for y in (0, 1)}
    for r, bag in zip(rows, bags):
        for f in {f for s in bag for f in s}:
            seen[r.label][f] = seen[r.label].get(f, 0) + r.weight
    kept = set()
    for f, toxic in seen[1].items():
        expected = (seen[0].get(f, 0) + 1) * n[1] / n[0]
        if toxic >= toxicity.LEAST_TOXIC and toxic - expected >= toxicity.LEAST_DEVIATIONS * math.sqrt(expected):
            kept.add(f)
    assert kept
    w, c = dict.fromkeys(kept, 0.0), toxicity.FIRST_LEAK
    total = sum(r.weight for r in rows)

    def margins(bag):
        return [toxicity.BIAS + sum(w.get(f, 0.0) for f in s) for s in bag]

    def score(bag):
        """Noisy-or of the sentences and the leak."""
        clean = 1.0
        for z in [*margins(bag), c]:
            clean *= 1.0 - 1.0 / (1.0 + math.exp(-z))
        return 1.0 - clean

    for _ in range(toxicity.ROUNDS):
        squares, squares_c = dict.fromkeys(kept, 1e-9), 1e-9
        for _ in range(toxicity.STEPS):
            gradient, gradient_c = {f: toxicity.PENALTY * v for f, v in w.items()}, 0.0
            for r, bag in zip(rows, bags):
                p = score(bag)
                factor = (-(1 - p) / max(p, 1e-9) if r.label else 1.0) * r.weight / total
                for s, z in zip(bag, margins(bag)):
                    for f in s:
                        if f in kept:
                            gradient[f] += factor / (1.0 + math.exp(-z))
                gradient_c += factor / (1.0 + math.exp(-c))
            for f in kept:
                squares[f] += gradient[f] ** 2
                w[f] -= toxicity.RATE * gradient[f] / math.sqrt(squares[f])
            squares_c += gradient_c**2
            c -= toxicity.LEAK_RATE * gradient_c / math.sqrt(squares_c)
    model = toxicity.fit(*tables, F.lit(True))
    assert set(model.features.tolist()) == kept and model.leak == pytest.approx(c, abs=1e-6)
    assert dict(zip(model.features.tolist(), model.weights)) == pytest.approx(w, abs=1e-4)
    found = {r.doc_id: r.score for r in toxicity.score(tables[0], model).collect()}
    for d in tables[0].collect():
        assert found[d.doc_id] == pytest.approx(score(sentences(d.text)), abs=1e-4)
