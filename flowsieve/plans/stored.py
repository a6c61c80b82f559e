"""Fits stored in a folder, to be loaded by another application.

A stored fit is a folder of Parquet tables (and of MLlib models where the fit has them): ``fit`` has one
row with the kind of the fit and the columns it was fitted on; the rest depends on the kind.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.feature import PCAModel
from pyspark.sql import Row, SparkSession

from flowsieve.operators.iforest import Forest
from flowsieve.operators.prep import Prep
from flowsieve.operators.recon import CurvedReconstruction, Reconstruction
from flowsieve.operators.stage2 import Stage2
from flowsieve.plans.detect import FittedForest, TwoStage

HEADER = "kind string, columns array<string>, names array<string>, numbers array<double>"
ARRAYS = ("means", "scales", "projections", "shifts", "centre", "components", "decoder")
TREE_MODELS = {m.__name__: m for m in (GBTClassificationModel, RandomForestClassificationModel)}


def store_fit(fit: Prep | Forest | Reconstruction | CurvedReconstruction | FittedForest | Stage2 | TwoStage, spark: SparkSession, folder: str) -> None:
    """Write ``fit`` to ``folder``, which must not hold one yet."""
    if isinstance(fit, Prep):
        _header(spark, folder, "prep", fit.columns)
        table = fit.table(spark).join(_places(spark, fit.columns), "feature")
        table.coalesce(1).write.parquet(f"{folder}/table")
    elif isinstance(fit, Forest):
        _header(spark, folder, "forest", fit.features, numbers=[fit.trees, fit.sample_rows])
        fit.nodes.write.parquet(f"{folder}/nodes")
    elif isinstance(fit, Reconstruction):
        _header(spark, folder, "reconstruction", fit.features, numbers=fit.means)
        fit.model.save(f"{folder}/components")
    elif isinstance(fit, CurvedReconstruction):
        arrays = {name: getattr(fit, name) for name in ARRAYS}
        _header(spark, folder, "curved reconstruction", fit.features)
        held = [(name, list(map(int, a.shape)), a.ravel().tolist()) for name, a in arrays.items()]
        spark.createDataFrame(held, "name string, shape array<int>, numbers array<double>").coalesce(1).write.parquet(f"{folder}/arrays")
    elif isinstance(fit, Stage2):
        kinds = [type(m).__name__ for m in fit.models]
        _header(spark, folder, "stage2", fit.features, [*fit.classes, *kinds], [len(fit.classes)])
        for k, model in enumerate(fit.models):
            model.save(f"{folder}/model-{k}")
    elif isinstance(fit, FittedForest):
        _header(spark, folder, "fitted forest", fit.prepared.columns, numbers=[fit.cut])
        for name in ("prepared", "forest"):
            store_fit(getattr(fit, name), spark, f"{folder}/{name}")
    elif isinstance(fit, TwoStage):
        _header(spark, folder, "two stages", fit.prepared.columns, numbers=[fit.limit])
        for name in ("prepared", "detector", "classifier"):
            store_fit(getattr(fit, name), spark, f"{folder}/{name}")
    else:
        raise TypeError(f"{type(fit).__name__} is no fit that can be stored")


def load_fit(
    spark: SparkSession, folder: str, columns: Sequence[str] | None = None
) -> Prep | Forest | Reconstruction | CurvedReconstruction | FittedForest | Stage2 | TwoStage:
    """The fit stored in ``folder``. ``columns``, if given, must be those it was fitted on, in order."""
    header = spark.read.schema(HEADER).parquet(f"{folder}/fit").first()
    held = tuple(header.columns)
    if columns is not None and tuple(columns) != held:
        missing, other = [c for c in held if c not in columns], [c for c in columns if c not in held]
        raise ValueError(f"fitted on other columns: missing {missing}, not fitted {other}, or in another order")
    if header.kind == "prep":
        return _prep(spark.read.parquet(f"{folder}/table").orderBy("place").collect())
    if header.kind == "forest":
        trees, sample_rows = (int(n) for n in header.numbers)
        return Forest(spark.read.parquet(f"{folder}/nodes"), held, trees, sample_rows)
    if header.kind == "reconstruction":
        return Reconstruction(held, tuple(header.numbers), PCAModel.load(f"{folder}/components"))
    if header.kind == "curved reconstruction":
        rows = spark.read.parquet(f"{folder}/arrays").collect()
        arrays = {r.name: np.array(r.numbers).reshape(r["shape"]) for r in rows}
        return CurvedReconstruction(held, *[arrays[name] for name in ARRAYS])
    if header.kind == "stage2":
        end = int(header.numbers[0])
        kinds = header.names[end:]
        models = tuple(TREE_MODELS[kind].load(f"{folder}/model-{k}") for k, kind in enumerate(kinds))
        return Stage2(held, tuple(header.names[:end]), models)
    if header.kind == "fitted forest":
        parts = [load_fit(spark, f"{folder}/{name}") for name in ("prepared", "forest")]
        return FittedForest(*parts, header.numbers[0])
    if header.kind == "two stages":
        parts = [load_fit(spark, f"{folder}/{name}") for name in ("prepared", "detector", "classifier")]
        return TwoStage(parts[0], parts[1], header.numbers[0], parts[2])
    raise ValueError(f"{folder} holds a fit of unknown kind {header.kind}")


def _header(
    spark: SparkSession,
    folder: str,
    kind: str,
    columns: Sequence[str],
    names: Sequence[str] = (),
    numbers: Sequence[float] = (),
) -> None:
    row = (kind, list(columns), list(names), [float(n) for n in numbers])
    spark.createDataFrame([row], HEADER).coalesce(1).write.parquet(f"{folder}/fit")


def _places(spark: SparkSession, columns: Sequence[str]):
    return spark.createDataFrame(list(zip(columns, range(len(columns)))), "feature string, place int")


def _prep(rows: list[Row]) -> Prep:
    """A few rows, one per column."""
    return Prep(
        tuple(r.feature for r in rows),
        {r.feature: r["median"] for r in rows},
        {r.feature: r.variance for r in rows},
        {r.feature: r.skew for r in rows},
        tuple(r.feature for r in rows if r.kept),
        tuple(r.feature for r in rows if r.skewed),
        {r.feature: r["mean"] for r in rows if r.kept},
        {r.feature: r.sd for r in rows if r.kept},
    )
