"""Quality by naive Bayes support vectors.

The indicators of a document's n-grams are scaled by the log ratio of their counts in the two classes,
and a linear hinge-loss model is fitted to the scaled, normalised vectors by dual coordinate descent.
Each block of training documents runs the descent on its own dual variables from the shared weights;
after every round the changes of all blocks are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.labelled import training_rows
from flowsieve.llm.textbytes import NOT_SPACE, Chunk, mixed, text_chunks, words
from flowsieve.session import written

BITS = 18
TRAIN_ROWS = 12_000
SMOOTHING = 1.0
COST, ROUNDS, EPOCHS = 10.0, 5, 4
# Steepness of the logistic curve from margins to scores.
STEEPNESS = 3.0


@dataclass
class Model:
    """Per hashed n-gram: the log-count ratio, and the weight on the scaled indicator."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float


def _features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs without repeats: words, pairs of words, and three-byte strings."""
    found = words(chunk, NOT_SPACE)
    shift = np.uint64(64 - BITS)
    pair = found.text[1:] == found.text[:-1]
    pairs = mixed(found.hash[:-1] * np.uint64(3) + found.hash[1:], 7)[pair]
    data = chunk.data.astype(np.uint64)
    triples = mixed(data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:], 9)
    at = np.arange(len(triples))
    text = np.searchsorted(chunk.ends, at, "right")
    whole = at + 3 <= chunk.ends[np.minimum(text, len(chunk.ends) - 1)]
    value = np.concatenate([found.hash, pairs, triples[whole]]) >> shift
    owner = np.concatenate([found.text, found.text[:-1][pair], text[whole]])
    key = np.unique(owner.astype(np.int64) << BITS | value.astype(np.int64))
    return key >> BITS, key & ((1 << BITS) - 1)


def _offsets(text: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))])


def fit(documents: DataFrame, labels: DataFrame, learnt: Column, label: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents for which ``learnt``, a condition on doc_id, holds.

    Without labelled documents, or with one class only, every weight is 0 and the bias leans to the
    class there is.
    """
    spark = documents.sparkSession

    names = ["row", "block", "weight", "label"]

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column("text")):
                text, feature = _features(chunk)
                n = len(chunk.ends)
                features = pa.ListArray.from_arrays(pa.array(_offsets(text, n), pa.int32()), pa.array(feature, pa.int32()))
                kept = [batch.column(c).slice(chunk.first, n) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, features], names=[*names, "features"])

    train = training_rows(documents, labels, label, learnt, rows)
    bagged = train.mapInArrow(bags, "row int, block int, weight long, label int, features array<int>")
    # A block is written to one file by one task, so later passes need no shuffle. Where such a file is
    # read in parts, each part is a block; dual variables belong to rows, so that parts may change.
    train = written(bagged.repartition("block"), "quality-bags")

    def class_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, n = np.zeros((2, 1 << BITS)), np.zeros(2, np.int64)
        for frame in frames:
            for y, weight, features in zip(frame.label, frame.weight, frame.features):
                counts[int(y > 0), features] += weight
                n[int(y > 0)] += weight
        for y in (0, 1):
            if n[y]:
                yield pd.DataFrame({"y": [y], "n": [n[y]], "counts": [counts[y].astype(np.float32).tobytes()]})

    # The training rows are bounded, so are these: one row per task and class.
    counts, n = np.full((2, 1 << BITS), SMOOTHING), np.zeros(2)
    for row in train.mapInPandas(class_counts, "y int, n long, counts binary").collect():
        counts[row.y] += np.frombuffer(row.counts, np.float32)
        n[row.y] += row.n
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratios[counts.sum(0) <= 2 * SMOOTHING] = 0.0
    if not n.all():
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), float(np.sign(n[1] - n[0])))

    weights, bias = np.zeros(1 << BITS), 0.0
    alphas = np.zeros(rows)
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((ratios, weights, bias, alphas))

        def descend(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            held = list(frames)
            for _, part in pd.concat(held).groupby("block") if held else ():
                # One order for all rounds.
                part = part.sort_values("row")
                change, bias_change, alpha = _descended(part, *shared.value)
                yield pd.DataFrame(
                    {"bias": [bias_change], "change": [change.astype(np.float32).tobytes()], "rows": [part.row.to_numpy()], "alpha": [alpha]}
                )

        found = train.mapInPandas(descend, "bias double, change binary, rows array<int>, alpha array<double>").collect()
        for row in found:
            weights = weights + np.frombuffer(row.change, np.float32) / len(found)
            bias += row.bias / len(found)
            alphas[row.rows] += (np.array(row.alpha) - alphas[row.rows]) / len(found)
        shared.unpersist()
    return Model(ratios, weights, bias)


def _descended(
    part: pd.DataFrame, ratios: np.ndarray, weights: np.ndarray, bias: float, alphas: np.ndarray
) -> tuple[np.ndarray, float, np.ndarray]:
    """Changes of weights and bias, and new dual variables, after some epochs over one block.

    A row that stands for several copies costs as much as all of them.
    """
    rows = []
    for features in part.features:
        x = ratios[features]
        rows.append((features, x / max(np.sqrt(x @ x), 1e-9)))
    y = np.where(part.label.to_numpy() > 0, 1.0, -1.0)
    alpha = alphas[part.row.to_numpy()]
    most = COST * part.weight.to_numpy()
    w, b = weights.copy(), bias
    squares = np.array([x @ x + 1.0 for _, x in rows])
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            features, x = rows[i]
            gradient = y[i] * (w[features] @ x + b) - 1.0
            new = min(max(alpha[i] - gradient / squares[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[features] += step * x
                b += step
                alpha[i] = new
    return w - weights, b - bias, alpha


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of ``documents``: the margin on a logistic curve, 0.5 at margin 0.

    An empty or null text has the bias as its margin. Every row is scored, whatever its id; rows that
    repeat score alike. Other columns are ignored; an empty table gives no rows.
    """
    product = (model.ratios * model.weights).astype(np.float64)
    held = documents.sparkSession.sparkContext.broadcast((product, model.ratios**2, model.bias))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, squares, bias = held.value
        for batch in batches:
            for chunk in text_chunks(batch.column("text")):
                text, feature = _features(chunk)
                n = len(chunk.ends)
                norm = np.sqrt(np.bincount(text, squares[feature], minlength=n))
                margin = np.bincount(text, product[feature], minlength=n) / np.maximum(norm, 1e-9) + bias
                p = 1.0 / (1.0 + np.exp(-np.clip(STEEPNESS * margin, -40, 40)))
                ids = batch.column("doc_id").slice(chunk.first, n)
                yield pa.RecordBatch.from_arrays([ids, pa.array(p)], names=["doc_id", "score"])

    slim = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return slim.mapInArrow(scored, "doc_id long, score double")
