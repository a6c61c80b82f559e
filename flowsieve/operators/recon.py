"""Reconstruction error of an autoencoder fitted on the benign rows.

The linear one keeps principal components. The curved one passes rows through a fixed random map first:
cosines of seeded projections, whose inner products approximate a Gaussian kernel (Rahimi, Recht 2007).
Principal components of the mapped rows are the narrow layer; the inputs are fitted back from them by
least squares. All that is fitted comes from sums over the rows: means, one covariance matrix, and one
matrix of products, whose sizes are set by the parameters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.columns import SEED, quoted
from flowsieve.operators.ordering import quantiles

BOUNDARY_SHARE = 0.95
# Cosines of the curved form, and by how much its least squares are damped (relative to the largest product).
COSINES, DAMPING = 64, 1e-9


@dataclass(frozen=True)
class Reconstruction:
    """Benign means and components; a row's error is what the components leave of it."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    model: PCAModel

    def score(self, df: DataFrame, name: str = "recon_error") -> DataFrame:
        """Add the mean squared error per row. The components are orthonormal, so the error is the
        squared length of the centred row minus that of its projection."""
        projected = self.model.transform(centred(df, self.features, self.means))
        squares = [F.pow(F.col(quoted(f)) - F.lit(m), 2) for f, m in zip(self.features, self.means)]
        length = squares[0]
        for square in squares[1:]:
            length = length + square
        kept = F.aggregate(vector_to_array("_z"), F.lit(0.0), lambda total, z: total + z * z)
        error = F.greatest(length - kept, F.lit(0.0)) / len(self.features)
        return projected.select(*[quoted(c) for c in df.columns], error.alias(name))


def centred(df: DataFrame, features: Sequence[str], means: Sequence[float]) -> DataFrame:
    columns = [(F.col(quoted(f)) - F.lit(m)).alias(f"_c{i}") for i, (f, m) in enumerate(zip(features, means))]
    names = [f"_c{i}" for i in range(len(features))]
    wide = df.select("*", *columns)
    return VectorAssembler(inputCols=names, outputCol="_x").transform(wide).drop(*names)


def fit_reconstruction(
    benign: DataFrame, features: Sequence[str], components: int | None = None
) -> Reconstruction:
    """Fit on benign rows only; by default a quarter of the dimensions are kept."""
    k = components or max(1, len(features) // 4)
    row = benign.agg(*[F.avg(quoted(f)).alias(f"m{i}") for i, f in enumerate(features)]).first()
    means = tuple(row[f"m{i}"] for i in range(len(features)))
    model = PCA(k=k, inputCol="_x", outputCol="_z").fit(centred(benign, features, means).select("_x"))
    return Reconstruction(tuple(features), means, model)


@dataclass(frozen=True)
class CurvedReconstruction:
    """A fixed map to cosines, components of the mapped benign rows, and the way back to the features.

    ``projections`` has a row per cosine, on features less their benign means and divided by their
    deviations (``scales``). ``components`` has a row per number of the narrow layer, and ``decoder`` a row
    per such number, and a last one of constants.
    """

    features: tuple[str, ...]
    means: np.ndarray
    scales: np.ndarray
    projections: np.ndarray
    shifts: np.ndarray
    centre: np.ndarray
    components: np.ndarray
    decoder: np.ndarray

    def errors(self, rows: np.ndarray) -> np.ndarray:
        """Mean squared error per row of ``rows`` (rows x features)."""
        scaled = (rows - self.means) / self.scales
        held = (cosines(scaled, self.projections, self.shifts) - self.centre) @ self.components.T
        return ((scaled - held @ self.decoder[:-1] - self.decoder[-1]) ** 2).mean(1)

    def score(self, df: DataFrame, name: str = "recon_error") -> DataFrame:
        """Add the mean squared error per row, in squared benign deviations of each feature, in one
        narrow Arrow pass. A row with a missing feature has no error."""
        model = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def error(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(model.value.errors(batch.to_numpy(dtype=float, na_value=np.nan)))

        inputs = F.struct(*[F.col(quoted(f)).cast("double").alias(f"f{i}") for i, f in enumerate(self.features)])
        found = df.withColumn("_error", error(inputs))
        return found.select(
            *[quoted(c) for c in df.columns], F.when(~F.isnan("_error"), F.col("_error")).alias(name)
        )


def cosines(scaled: np.ndarray, projections: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    return np.cos(scaled @ projections.T + shifts)


def fit_curved_reconstruction(
    benign: DataFrame,
    features: Sequence[str],
    components: int | None = None,
    cosine_count: int = COSINES,
    width: float | None = None,
    seed: int = SEED,
) -> CurvedReconstruction:
    """Fit on benign rows only; by default the narrow layer has a fifth as many numbers as there are
    cosines.

    ``width`` is the distance, in deviations, over which rows count as alike; by default it is the square
    root of the number of features. A feature without deviation is left at its scale; rows
    with a missing feature teach nothing.
    """
    names = [f"f{i}" for i in range(len(features))]
    rows = benign.select(*[F.col(quoted(f)).cast("double").alias(n) for f, n in zip(features, names)]).dropna()
    row = rows.agg(
        *[F.avg(n).alias(f"m{n}") for n in names], *[F.stddev_pop(n).alias(f"s{n}") for n in names]
    ).first()
    if row[f"m{names[0]}"] is None:
        raise ValueError("there are no benign rows to learn from")
    means = np.array([row[f"m{n}"] for n in names])
    scales = np.array([row[f"s{n}"] or 1.0 for n in names])
    rng = np.random.default_rng(seed)
    width = width or float(np.sqrt(len(names)))
    projections = rng.normal(scale=1.0 / width, size=(cosine_count, len(names)))
    shifts = rng.uniform(0.0, 2 * np.pi, cosine_count)

    def entries(block: np.ndarray) -> np.ndarray:
        scaled = (block - means) / scales
        return np.hstack([cosines(scaled, projections, shifts), scaled, np.ones((len(block), 1))])

    gram = product_sums(rows, entries, cosine_count + len(names) + 1)
    n, first = gram[-1, -1], slice(0, cosine_count)
    centre = gram[-1, first] / n
    covariance = gram[first, first] / n - np.outer(centre, centre)
    k = components or max(2, cosine_count // 5)
    held = np.linalg.eigh(covariance)[1][:, ::-1][:, :k].T
    # What the narrow layer holds is linear in the cosines, so its products follow from theirs.
    layer = np.zeros((k + 1, cosine_count + 1))
    layer[:k, first], layer[:k, -1], layer[k, -1] = held, -held @ centre, 1.0
    inner = [*range(cosine_count), len(gram) - 1]
    squares = layer @ gram[np.ix_(inner, inner)] @ layer.T
    crossed = layer @ gram[np.ix_(inner, range(cosine_count, len(gram) - 1))]
    decoder = np.linalg.solve(squares + DAMPING * np.abs(squares).max() * np.eye(k + 1), crossed)
    return CurvedReconstruction(tuple(features), means, scales, projections, shifts, centre, held, decoder)


def product_sums(rows: DataFrame, entries: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of the products of every two of a row's ``size`` entries.

    A task adds up its rows to one matrix, whose size the parameters set, and matrices are added up
    entry by entry; only the last one reaches the driver.
    """

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for frame in frames:
            block = entries(frame.to_numpy(dtype=float))
            total += block.T @ block
        i, j = np.triu_indices(size)
        yield pd.DataFrame({"i": i, "j": j, "total": total[i, j]})

    sums = rows.mapInPandas(add, "i int, j int, total double").groupBy("i", "j")
    found = sums.agg(F.sum("total").alias("total")).toPandas()
    gram = np.zeros((size, size))
    gram[found["i"], found["j"]] = gram[found["j"], found["i"]] = found["total"]
    return gram


def boundary(benign_errors: DataFrame, error: str = "recon_error", share: float = BOUNDARY_SHARE) -> float:
    """The given percentile of the benign training errors."""
    return quantiles(benign_errors, [error], [share])[error][0]


def flag_above(limit: float, error: str = "recon_error") -> Column:
    return F.coalesce(F.col(error) > F.lit(limit), F.lit(False)).cast("int")
