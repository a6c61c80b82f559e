"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence scores the logistic function of its words' weights; the noisy-or of its sentences scores
the document, ``1 - (1 - leak) * prod(1 - p)``; the leak stands for toxic labels that no sentence
explains, so that long documents do not add up to a toxic one. Weights are fitted to document labels alone, by gradient descent
on the noisy-or's log loss inside blocks of documents whose weights are averaged after every round.
The sentence scores then tell where the offending sentences are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.labelled import TRAIN_ROWS, training_rows
from flowsieve.llm.textbytes import LETTERS_AND_DIGITS, LOWER, Chunk, byte_class, mixed, text_chunks, words
from flowsieve.session import written

BITS = 20
# Lengths in bytes of the word beginnings that are features beside the words.
PREFIXES = (4, 5, 6)
# Features in fewer toxic training documents, or not that many deviations above the number expected
# from the other documents, have no weight.
LEAST_TOXIC, LEAST_DEVIATIONS = 5, 4.0
ROUNDS, STEPS, RATE, PENALTY = 4, 100, 0.5, 1e-4
# Margin of a sentence without weighty words, fixed so low that a thousand of them are still clean, and
# the leak's first margin and its rate.
BIAS = -9.0
FIRST_LEAK, LEAK_RATE = -4.0, 0.05
SENTENCE_WORDS = 64

_ENDS = byte_class((0x0A, 0x0A), (0x0D, 0x0D), (0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F))


@dataclass
class Model:
    """The features with a weight, their weights, and the margin of the leak."""

    features: np.ndarray
    weights: np.ndarray
    leak: float

    def table(self) -> np.ndarray:
        """Weights by feature."""
        out = np.zeros(1 << BITS)
        out[self.features] = self.weights
        return out


@dataclass
class _Sentences:
    """Features of a chunk's words, as (feature, sentence), and the text and byte range of each sentence."""

    feature: np.ndarray
    sentence: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _sentences(chunk: Chunk) -> _Sentences:
    """Sentences end at ``. ! ?`` or a line break, and after ``SENTENCE_WORDS`` words."""
    found = words(chunk, LETTERS_AND_DIGITS)
    if not len(found.hash):
        none = np.zeros(0, np.int64)
        return _Sentences(none, none, none, none, none)
    # The word itself, and its beginnings, which compounds share. One row of features per word.
    data, length = LOWER[chunk.data].astype(np.uint64), found.end - found.start
    hashes, there = [found.hash], [np.ones(len(length), bool)]
    beginning = np.zeros(len(length), np.uint64)
    for at in range(PREFIXES[-1]):
        beginning |= data[np.minimum(found.start + at, len(data) - 1)] << np.uint64(8 * at)
        if at + 1 in PREFIXES:
            hashes.append(mixed(beginning, at))
            there.append(length > at + 1)
    there = np.stack(there, 1)
    feature = (np.stack(hashes, 1) >> np.uint64(64 - BITS)).astype(np.int64)[there]
    stops = np.concatenate([[0], np.cumsum(_ENDS[chunk.data])])[found.start]
    new = np.ones(len(stops), bool)
    new[1:] = (stops[1:] != stops[:-1]) | (found.text[1:] != found.text[:-1])
    run = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    new |= (np.arange(len(new)) - run) % SENTENCE_WORDS == 0
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new)) - 1
    text = found.text[first]
    sentence = np.repeat(np.cumsum(new) - 1, there.sum(1))
    return _Sentences(
        feature, sentence, text, found.start[first] - chunk.starts[text], found.end[last] - chunk.starts[text]
    )


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _margins(weights: np.ndarray, s: _Sentences) -> np.ndarray:
    return np.bincount(s.sentence, weights[s.feature], minlength=len(s.text)) + BIAS


def fit(documents: DataFrame, labels: DataFrame, learnt: Column, label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents for which ``learnt``, a condition on doc_id, holds.

    Without labelled documents every weight is 0.
    """
    spark = documents.sparkSession

    names = ["block", "weight", "label"]

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column("text")):
                s, n = _sentences(chunk), len(chunk.ends)
                per_text = np.bincount(s.text, minlength=n)
                per_sentence = np.bincount(s.sentence, minlength=len(s.text))
                texts = pa.ListArray.from_arrays(_ends(per_text), pa.array(per_sentence, pa.int32()))
                word_count = np.bincount(s.text[s.sentence], minlength=n)
                features = pa.ListArray.from_arrays(_ends(word_count), pa.array(s.feature, pa.int32()))
                kept = [batch.column(c).slice(chunk.first, n) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, texts, features], names=[*names, "sizes", "features"])

    train = training_rows(documents, labels, label, learnt, rows)
    bags_schema = "block int, weight long, label int, sizes array<int>, features array<int>"
    # A block is written to one file by one task, so later passes need no shuffle. Where such a file is
    # read in parts, each part is a block.
    train = written(train.mapInArrow(bags, bags_schema).repartition("block"), "toxicity-bags")

    def document_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, 1 << BITS), np.int64)
        for frame in frames:
            for y, weight, features in zip(frame.label, frame.weight, frame.features):
                counts[int(y > 0), np.unique(features)] += weight
        seen = np.flatnonzero(counts.any(0))
        yield pd.DataFrame({"feature": seen, "clean": counts[0, seen], "toxic": counts[1, seen]})

    n = {r.y: r.n for r in train.groupBy((F.col("label") > 0).alias("y")).agg(F.sum("weight").alias("n")).collect()}
    counted = train.mapInPandas(document_counts, "feature int, clean long, toxic long").groupBy("feature")
    counted = counted.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    screened = counted.filter(_stands_out(n.get(False, 0), n.get(True, 0)))
    features = np.sort(np.array([r.feature for r in screened.select("feature").collect()], np.int64))
    weights, leak = np.zeros(len(features)), FIRST_LEAK

    for _ in range(ROUNDS):
        start = spark.sparkContext.broadcast((weights, leak))

        def descend(frames: Iterator[pd.DataFrame], start=start) -> Iterator[pd.DataFrame]:
            held = list(frames)
            for _, block in pd.concat(held).groupby("block") if held else ():
                w, c = _descended(block.reset_index(drop=True), *start.value, features)
                yield pd.DataFrame({"n": [block.weight.sum()], "leak": [c], "weights": [w]})

        # One row per block, with a number per feature that stands out.
        found = train.mapInPandas(descend, "n long, leak double, weights array<double>").collect()
        if found:
            total = sum(r.n for r in found)
            weights = sum(np.array(r.weights) * (r.n / total) for r in found)
            leak = sum(r.leak * r.n for r in found) / total
        start.unpersist()
    return Model(features, np.asarray(weights, float), float(leak))


def _stands_out(clean: int, toxic: int) -> Column:
    """Features that occur in toxic documents clearly more often than in others.

    ``clean`` and ``toxic``: training documents by class; the columns of these names count those with
    the feature.
    """
    expected = (F.col("clean") + 1) * F.lit(toxic / max(clean, 1))
    enough = F.col("toxic") - expected >= F.lit(LEAST_DEVIATIONS) * F.sqrt(expected)
    return (F.col("toxic") >= LEAST_TOXIC) & enough


def _ends(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


def _descended(
    block: pd.DataFrame, weights: np.ndarray, leak: float, features: np.ndarray
) -> tuple[np.ndarray, float]:
    """Adaptive gradient steps on one block, in which a row counts by its weight."""
    sizes = np.concatenate(block.sizes.to_list()).astype(np.int64)
    feature = np.concatenate(block.features.to_list()).astype(np.int64)
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    place = np.full(1 << BITS, -1)
    place[features] = np.arange(len(features))
    feature = place[feature]
    keep = feature >= 0
    per_text = np.array([len(x) for x in block.sizes])
    text = np.repeat(np.arange(len(block)), per_text)
    s = _Sentences(feature[keep], sentence[keep], text, text, text)
    y = block.label.to_numpy() > 0
    share = block.weight.to_numpy() / block.weight.sum()
    w, c = weights.copy(), leak
    scale_w, scale_c = np.full(len(w), 1e-9), 1e-9
    for _ in range(STEPS):
        z = _margins(w, s)
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
        clean = np.exp(-np.bincount(text, _softplus(z), minlength=len(block)) - _softplus(c))
        # Log loss by the margin of a sentence: p if its document is clean, else -p (1 - P) / P.
        factor = np.where(y, -clean / np.maximum(1 - clean, 1e-9), 1.0) * share
        g = factor[text] * p
        grad = np.bincount(s.feature, g[s.sentence], minlength=len(w)) + PENALTY * w
        scale_w += grad**2
        w -= RATE * grad / np.sqrt(scale_w)
        grad_c = factor.sum() / (1.0 + np.exp(-c))
        scale_c += grad_c**2
        c -= LEAK_RATE * grad_c / np.sqrt(scale_c)
    return w, float(c)


def _broadcast(documents: DataFrame, model: Model):
    return documents.sparkSession.sparkContext.broadcast(model)


def _scores(s: _Sentences, n: int, weights: np.ndarray, leak: float) -> tuple[np.ndarray, np.ndarray]:
    """Margins of the sentences, and scores of the ``n`` texts."""
    z = _margins(weights, s)
    return z, 1.0 - np.exp(-np.bincount(s.text, _softplus(z), minlength=n) - _softplus(leak))


def without_toxic(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents``, with all their columns, that score below ``threshold``."""
    held = _broadcast(documents, model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        weights, leak = model.table(), model.leak
        for batch in batches:
            for chunk in text_chunks(batch.column("text")):
                n = len(chunk.ends)
                _, total = _scores(_sentences(chunk), n, weights, leak)
                yield batch.slice(chunk.first, n).filter(pa.array(total < threshold))

    return documents.mapInArrow(clean, documents.schema)


def score(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, offending) for each row of ``documents``.

    ``offending``: (start, end, score) of the sentences whose own score reaches ``threshold``, in
    characters. An empty or null text has no sentence and scores the leak. Every row is scored, whatever its
    id; rows that repeat score alike. Other columns are ignored; an empty table gives no rows.
    """
    held = _broadcast(documents, model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        weights, leak = model.table(), model.leak
        for batch in batches:
            for chunk in text_chunks(batch.column("text")):
                s, n = _sentences(chunk), len(chunk.ends)
                z, total = _scores(s, n, weights, leak)
                p = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
                bad = np.flatnonzero(p >= threshold)
                lead = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
                base = chunk.starts[s.text[bad]]
                start, end = (lead[base + edge[bad]] - lead[base] for edge in (s.start, s.end))
                spans = pa.StructArray.from_arrays(
                    [pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(p[bad])], ["start", "end", "score"]
                )
                offending = pa.ListArray.from_arrays(_ends(np.bincount(s.text[bad], minlength=n)), spans)
                ids = batch.column("doc_id").slice(chunk.first, n)
                yield pa.RecordBatch.from_arrays([ids, pa.array(total), offending], names=["doc_id", "score", "offending"])

    slim = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return slim.mapInArrow(scored, "doc_id long, score double, offending array<struct<start:long,end:long,score:double>>")
