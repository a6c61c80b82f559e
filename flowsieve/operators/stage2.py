"""Second stage: a classifier trained on the flagged training rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.columns import SEED, quoted, total_of
from flowsieve.operators.routing import confidence, predicted_class
from flowsieve.session import with_checkpoints, written

KINDS = ("boosting", "forest")
# Classes boosted at the same time: their jobs are short and leave cores idle one after the other.
CLASSES_AT_ONCE = 4


@dataclass(frozen=True)
class Stage2:
    """A fitted second stage.

    ``models`` holds a forest, or one boosted model for two classes, or one for each of more classes
    (that class against the rest), or none where the training rows had a single class.
    """

    features: tuple[str, ...]
    classes: tuple[str, ...]
    models: tuple[GBTClassificationModel | RandomForestClassificationModel, ...]

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``probabilities`` (they sum to 1), ``predicted`` (class name) and ``confidence``."""
        assembler = VectorAssembler(inputCols=list(self.features), outputCol="_features")
        scored = assembler.transform(df)
        names = F.array(*[F.lit(c) for c in self.classes])
        if len(self.models) == 1:
            scored = self.models[0].transform(scored)
            probabilities = vector_to_array("_probability")
        elif self.models:
            for model in self.models:
                scored = model.transform(scored)
            chances = [chance(f"_raw{k}") for k in range(len(self.models))]
            scored = scored.withColumns({f"_chance{k}": c for k, c in enumerate(chances)})
            held = [F.col(f"_chance{k}") for k in range(len(chances))]
            probabilities = F.array(*[c / total_of(held) for c in held])
        else:
            probabilities = F.array(F.lit(1.0))
        return scored.select(
            *[quoted(c) for c in df.columns], probabilities.alias("probabilities")
        ).select(
            "*",
            predicted_class(F.col("probabilities"), names).alias("predicted"),
            confidence(F.col("probabilities")).alias("confidence"),
        )


def chance(raw: str) -> Column:
    """The logistic curve at twice the margin: how likely a class is against the rest."""
    return 1.0 / (1.0 + F.exp(-2.0 * vector_to_array(raw)[1]))


def fit_stage2(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    rounds: int = 200,
    depth: int = 6,
    learning_rate: float = 0.1,
    seed: int = SEED,
    kind: str = "boosting",
    bootstrap: bool = True,
    feature_subset: str = "auto",
) -> Stage2:
    """Boosted trees, or with ``kind="forest"`` a random forest of ``rounds`` trees.

    More than two classes are boosted one against the rest, some at a time; the chances of all
    classes are divided by their sum. ``bootstrap`` and ``feature_subset`` are the forest's. Rows
    without a label teach nothing.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is {kind}, not one of {KINDS}")
    with_checkpoints(train.sparkSession)
    named = train.select(*[quoted(f) for f in features], F.col(quoted(label)).cast("string").alias("_class"))
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features")
    rows = written(assembler.transform(named.dropna(subset=["_class"])).select("_features", "_class"), "stage2-rows")
    classes = tuple(r[0] for r in rows.select("_class").distinct().orderBy("_class").collect())
    if not classes:
        raise ValueError("there are no labelled rows to learn from")
    if len(classes) == 1:
        return Stage2(tuple(features), classes, ())
    shared = dict(featuresCol="_features", labelCol="_label", maxDepth=depth, seed=seed)
    if kind == "forest":
        forest = RandomForestClassifier(
            numTrees=rounds, bootstrap=bootstrap, featureSubsetStrategy=feature_subset,
            predictionCol="_prediction", probabilityCol="_probability", rawPredictionCol="_raw", **shared,
        )
        place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("_class")) - 1
        model = forest.fit(rows.select("_features", place.cast("double").alias("_label")))
        return Stage2(tuple(features), classes, (model,))

    def boosted(k: int) -> GBTClassificationModel:
        booster = GBTClassifier(maxIter=rounds, stepSize=learning_rate, **shared)
        if len(classes) == 2:
            booster.setPredictionCol("_prediction").setProbabilityCol("_probability").setRawPredictionCol("_raw")
        else:
            booster.setPredictionCol("").setProbabilityCol("").setRawPredictionCol(f"_raw{k}")
        own = F.col("_class") == F.lit(classes[k])
        return booster.fit(rows.select("_features", own.cast("double").alias("_label")))

    if len(classes) == 2:
        return Stage2(tuple(features), classes, (boosted(1),))
    with ThreadPool(min(CLASSES_AT_ONCE, len(classes))) as pool:
        models = pool.map(inheritable_thread_target(train.sparkSession)(boosted), range(len(classes)))
    return Stage2(tuple(features), classes, tuple(models))
