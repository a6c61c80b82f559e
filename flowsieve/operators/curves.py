"""Threshold-free evaluation of a (label, score) table, higher score = more anomalous.

All curves start from counts per distinct score, combined before the shuffle, so a score shared by
a third of the rows is one row; the running counts over them come from ``running_sums``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowsieve.functions.columns import count_where, ratio
from flowsieve.operators.ordering import running_sums
from flowsieve.session import written


def score_counts(df: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    return df.groupBy(F.col(score).alias("threshold")).agg(
        count_where(F.col(label) == 1).alias("pos"), count_where(F.col(label) == 0).alias("neg")
    )


def ranked_counts(
    df: DataFrame, score: str = "score", label: str = "y", task_rows: int | None = None
) -> DataFrame:
    """Per distinct score, from the highest down: ``tp``, ``fp`` if all from there up are flagged.

    ``positives`` and ``negatives`` are the totals. ``df`` is read once: the totals are sums of the
    stored counts. A NULL score is the lowest one.
    """
    counts = written(score_counts(df, score, label), "score-counts")
    totals = counts.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
    placed = running_sums(counts, "threshold", ["pos", "neg"], descending=True, task_rows=task_rows)
    return placed.withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp"}).select(
        "*",
        F.lit(totals.pos or 0).cast("bigint").alias("positives"),
        F.lit(totals.neg or 0).cast("bigint").alias("negatives"),
    )


def roc_curve(ranked: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, and the start (NULL, 0, 0)."""
    points = ranked.select(
        "threshold",
        ratio(F.col("fp"), F.col("negatives")).alias("fpr"),
        ratio(F.col("tp"), F.col("positives")).alias("tpr"),
    )
    start = ranked.sparkSession.createDataFrame([(None, 0.0, 0.0)], points.schema)
    return points.unionByName(start)


def roc_auc(ranked: DataFrame) -> DataFrame:
    """Share of (positive, negative) pairs ranked right, ties counting one half."""
    below = F.col("negatives") - F.col("fp")
    wins = F.sum(F.col("pos") * (below + F.col("neg") / 2.0))
    pairs = F.max("positives").cast("double") * F.max("negatives")
    return ranked.agg(ratio(wins, pairs).alias("auc"))


def precision_recall_curve(ranked: DataFrame) -> DataFrame:
    """(threshold, precision, recall) per distinct score, and the end (NULL, 1, 0)."""
    points = ranked.select(
        "threshold",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("positives")).alias("recall"),
    )
    end = ranked.sparkSession.createDataFrame([(None, 1.0, 0.0)], points.schema)
    return points.unionByName(end)


def average_precision(ranked: DataFrame) -> DataFrame:
    """Sum of precision times the recall gained. The gain of a score is its own positives."""
    gain = ratio(F.col("pos"), F.col("positives"))
    return ranked.agg(
        F.sum(gain * ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("average_precision")
    )


def best_f1(ranked: DataFrame) -> DataFrame:
    """Threshold with the highest F1 on the precision-recall curve; the lowest one on ties."""
    p = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = ratio(F.col("tp"), F.col("positives"))
    f1 = 2 * p * r / F.greatest(p + r, F.lit(1e-9))
    point = F.struct("threshold", p.alias("precision"), r.alias("recall"), f1.alias("f1"))
    order = F.struct(f1, -F.col("threshold"))
    return ranked.agg(F.max_by(point, order).alias("_p")).select("_p.*")


def ks_distance(ranked: DataFrame) -> DataFrame:
    """Largest gap between the two score distributions, and where it is."""
    gap = F.abs(ratio(F.col("tp"), F.col("positives")) - ratio(F.col("fp"), F.col("negatives")))
    order = F.struct(gap, -F.col("threshold"))
    return ranked.agg(
        F.max(gap).alias("ks"), F.max_by("threshold", order).alias("threshold")
    )


def overlap_verdict(ks: DataFrame, limit: float = 0.5) -> DataFrame:
    """Below the limit no threshold separates the classes."""
    return ks.select(
        "ks",
        F.when(F.col("ks") < limit, "overlap is structural").otherwise("threshold can help").alias(
            "verdict"
        ),
    )


def separation(
    df: DataFrame, scores: list[str], label: str = "y", task_rows: int | None = None
) -> DataFrame:
    """KS distance and AUC per score column (detector), from one pass over ``df``."""
    each = F.array(*[F.struct(F.lit(s).alias("detector"), F.col(s).cast("double").alias("threshold")) for s in scores])
    tidy = df.select(F.col(label).alias("_y"), F.explode(each).alias("e"))
    counts = tidy.groupBy("e.detector", "e.threshold").agg(
        count_where(F.col("_y") == 1).alias("pos"), count_where(F.col("_y") == 0).alias("neg")
    )
    counts = written(counts, "score-counts")
    # Every detector scores the same rows.
    totals = counts.filter(F.col("detector") == scores[0])
    totals = totals.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
    positives, negatives = F.lit(totals.pos or 0), F.lit(totals.neg or 0)
    ranked = running_sums(
        counts, "threshold", ["pos", "neg"], descending=True, task_rows=task_rows, by=["detector"]
    )
    gap = F.abs(ratio(F.col("cum_pos"), positives) - ratio(F.col("cum_neg"), negatives))
    wins = F.sum(F.col("pos") * (negatives - F.col("cum_neg") + F.col("neg") / 2.0))
    return ranked.groupBy("detector").agg(
        F.max(gap).alias("ks"), ratio(wins, positives.cast("double") * negatives).alias("auc")
    )


def rank_detectors(measured: DataFrame, first: str) -> DataFrame:
    """Detectors by KS, and their lift over the ``first`` one. One row per detector."""
    base = measured.filter(F.col("detector") == first).select(F.col("ks").alias("_base"))
    order = W.orderBy(F.col("ks").desc(), "detector")
    return measured.join(F.broadcast(base), F.lit(True)).select(
        "detector",
        "ks",
        "auc",
        F.row_number().over(order).cast("bigint").alias("place"),
        (F.col("ks") - F.col("_base")).alias("lift"),
    )
