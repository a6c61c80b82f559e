"""Whole runs: detect, triage and report; compare detectors; two stages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.columns import SEED
from flowsieve.operators import ensemble, iforest, knowledge, lof, prep, recon, routing, stage2, triage, windows
from flowsieve.operators.ordering import quantiles
from flowsieve.session import drop_written, written, written_lean


# What a window of traffic is scored on.
WINDOW_FEATURES = ["n_bytes", "n_packets", "n_dst_ports", "failed_ratio"]


def forest_scores(
    df: DataFrame,
    features: Sequence[str],
    id_column: str,
    trees: int = iforest.TREES,
    seed: int = SEED,
    impute: str = "zero",
    log_skewed: bool = False,
    drop_constant: bool = False,
    two_sided: bool = False,
) -> DataFrame:
    """Prepare, fit and score; adds ``if_score``, lower = more anomalous.

    ``df`` is read a few times and should be a stored table. Preparation and scoring are expressions
    on its columns, so rows keep their place: nothing is shuffled or joined back by id.
    """
    fitted = prep.fit_prep(
        df, features, two_sided=two_sided, impute=impute,
        drop_constant=drop_constant, log_skewed=log_skewed,
    )
    forest = iforest.fit_forest(
        fitted.transform(df, [id_column]), fitted.kept, [id_column], trees=trees, seed=seed
    )
    scored = forest.score(df, inputs=[fitted.scaled(c) for c in fitted.kept])
    return scored.withColumn("if_score", -F.col("anomaly_score")).drop("mean_path", "anomaly_score")


@dataclass(frozen=True)
class FittedForest:
    """A preparation, a forest and the score below which rows are flagged, all fitted beforehand."""

    prepared: prep.Prep
    forest: iforest.Forest
    cut: float

    def run(self, df: DataFrame) -> DataFrame:
        """Add ``if_score``, lower = more anomalous, and ``flag``, where the rows are."""
        scored = self.forest.score(df, inputs=[self.prepared.scaled(c) for c in self.prepared.kept])
        scored = scored.withColumn("if_score", -F.col("anomaly_score")).drop("mean_path", "anomaly_score")
        return scored.withColumn("flag", F.coalesce(F.col("if_score") < F.lit(self.cut), F.lit(False)).cast("int"))


def fit_forest_detector(
    df: DataFrame, features: Sequence[str], id_column: str, contamination: float, trees: int = iforest.TREES, seed: int = SEED
) -> FittedForest:
    """Fit on a stored table; the cut is the ``contamination`` quantile of its own scores."""
    fitted = prep.fit_prep(df, features, two_sided=False, impute="zero", drop_constant=False, log_skewed=False)
    forest = iforest.fit_forest(fitted.transform(df, [id_column]), fitted.kept, [id_column], trees=trees, seed=seed)
    scores = written(FittedForest(fitted, forest, 0.0).run(df).select("if_score"), "forest-scores")
    return FittedForest(fitted, forest, quantiles(scores, ["if_score"], [contamination])["if_score"][0])


def squared_z(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add ``if_score``: minus the sum of squared z-scores. A deterministic score for checks."""
    fitted = prep.fit_prep(df, features, drop_constant=True, log_skewed=False)
    total = sum((F.pow(fitted.scaled(c), 2) for c in fitted.kept), F.lit(0.0))
    return df.withColumn("if_score", -total)


def flag_scored(scored: DataFrame, contamination: float) -> DataFrame:
    """Store the scored rows, and add ``flag`` for the lowest-scored fraction."""
    stored = written(scored, "scored")
    low = iforest.flag_lowest(stored, "if_score", contamination)
    return stored.withColumn("flag", F.coalesce(low, F.lit(False)).cast("int"))


def ranked_findings(flagged: DataFrame, id_column: str, time: str = "ts") -> DataFrame:
    """Typed findings, the worst per type and half hour, ranked, with knowledge."""
    stats = triage.baseline_stats(flagged)
    typed = triage.classify_flagged(flagged, stats)
    kept = triage.best_per_bucket(typed, [id_column], time=time)
    return knowledge.enrich(triage.rank_findings(kept, [id_column], time=time))


def analyze(
    records: DataFrame,
    window: str = "5 minutes",
    contamination: float = 0.02,
    time: str = "ts",
    source: str = "src",
    forest: bool = True,
) -> DataFrame:
    """Typed findings (ts, src_ip, type, severity, if_score and the features) of raw records.

    Records become features per source and window; the ``contamination`` share of windows with the
    lowest scores is flagged and typed. The score is the isolation forest's, or, without ``forest``,
    minus the sum of squared z-scores.
    """
    features = windows.window_features(records, window, time, source)
    features = features.withColumnsRenamed({"window_start": "ts", source: "src_ip"})
    moment = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    features = written(features.withColumn("window_id", F.concat_ws("@", "src_ip", moment)), "windows")
    if forest:
        scored = forest_scores(features, WINDOW_FEATURES, "window_id")
    else:
        scored = squared_z(features, WINDOW_FEATURES)
    flagged = flag_scored(scored, contamination).withColumns(
        {
            "flow_byts_s": F.col("n_bytes"),
            "flow_pkts_s": F.col("n_packets"),
            "fwd_bytes": F.col("n_bytes"),
            "rst_flag": F.col("failed_ratio"),
            "syn_flag": F.col("n_dst_ports"),
            "flow_duration_s": F.lit(0.0),
            "total_pkts": F.col("n_packets"),
        }
    )
    found = triage.classify_flagged(flagged, triage.baseline_stats(flagged))
    return found.select("ts", "src_ip", "type", "severity", "if_score", *WINDOW_FEATURES)


@dataclass(frozen=True)
class TwoStage:
    """Everything fitted on the training rows."""

    prepared: prep.Prep
    detector: recon.Reconstruction
    limit: float
    classifier: stage2.Stage2

    def run(
        self, test: DataFrame, keep: Sequence[str], confidence: float,
        medians: dict[str, float] | None = None,
    ) -> DataFrame:
        """Route test rows; ``medians`` of the test table itself may replace the trained ones."""
        scored = self.detector.score(self.prepared.transform(test, keep, medians))
        flagged = scored.withColumn("flag", recon.flag_above(self.limit))
        return routing.route(self.classifier.predict(flagged), confidence).drop(
            *self.prepared.kept, "probabilities"
        )


def fit_two_stage(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    category: str,
    hidden: Sequence[str] = (),
    rounds: int = 200,
    depth: int = 6,
) -> TwoStage:
    """Reconstruction detector on benign rows, then a classifier on what it flags in training."""
    prepared = prep.fit_prep(train, features)
    keep = list(dict.fromkeys([label, category]))
    matrix = written(prepared.transform(train, keep), "train")
    benign = matrix.filter(F.col(label) == 0)
    detector = recon.fit_reconstruction(benign, prepared.kept)
    errors = written(detector.score(matrix), "train-errors")
    limit = recon.boundary(errors.filter(F.col(label) == 0))
    flagged = errors.withColumn("flag", recon.flag_above(limit))
    known = written(routing.hold_out(flagged, category, hidden, "flag"), "stage2-train")
    classifier = stage2.fit_stage2(known, prepared.kept, category, rounds=rounds, depth=depth)
    return TwoStage(prepared, detector, limit, classifier)


def detector_scores(
    df: DataFrame, features: Sequence[str], id_column: str, label: str, neighbours: int = lof.NEIGHBOURS
) -> DataFrame:
    """(id, label, if_score, lof_score, recon_score, ensemble), all higher = more anomalous."""
    fitted = prep.fit_prep(df, features)
    matrix = written_lean(fitted.transform(df, [id_column, label]), "matrix")
    forest = iforest.fit_forest(matrix, fitted.kept, [id_column])
    detector = recon.fit_reconstruction(matrix.filter(F.col(label) == 0), fitted.kept)
    scored = detector.score(forest.score(matrix), "recon_score").select(
        id_column, label, F.col("anomaly_score").alias("if_score"), "recon_score"
    )
    local = lof.local_outlier_factor(matrix, fitted.kept, id_column, neighbours)
    joined = written_lean(scored.join(local.withColumnRenamed("lof", "lof_score"), id_column), "detectors")
    drop_written(matrix, local)
    return ensemble.mean_score(joined, ["if_score", "lof_score", "recon_score"])
