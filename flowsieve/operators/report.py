"""Confusion counts and the metrics built on them. Every function is one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.columns import count_where, ratio
from flowsieve.session import written


def confusion(df: DataFrame, label: str = "y", flag: str = "flag") -> DataFrame:
    y, f = F.col(label), F.col(flag)
    return df.agg(
        count_where((y == 0) & (f == 0)).alias("tn"),
        count_where((y == 0) & (f == 1)).alias("fp"),
        count_where((y == 1) & (f == 0)).alias("fn"),
        count_where((y == 1) & (f == 1)).alias("tp"),
    )


def metrics(df: DataFrame, label: str = "y", flag: str = "flag") -> DataFrame:
    """Precision, recall, F1 and accuracy of the positive class; 0 on empty denominators."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return confusion(df, label, flag).select(
        "*",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
    )


def classification_report(df: DataFrame, label: str = "y", flag: str = "flag") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def entry(name: str, hit, wrong, missed):
        return F.struct(
            F.lit(name).alias("class"),
            ratio(hit, hit + wrong).alias("precision"),
            ratio(hit, hit + missed).alias("recall"),
            ratio(2 * hit, 2 * hit + wrong + missed).alias("f1"),
            (hit + missed).alias("support"),
        )

    per_class = confusion(df, label, flag).select(
        F.array(entry("0", tn, fn, fp), entry("1", tp, fp, fn)).alias("_c"),
        ratio(tp + tn, tp + tn + fp + fn).alias("_acc"),
        (tp + tn + fp + fn).alias("_all"),
    )
    measures = ("precision", "recall", "f1")
    c0, c1 = F.col("_c")[0], F.col("_c")[1]

    def average(name: str, w0, w1):
        return F.struct(
            F.lit(name).alias("class"),
            *[(c0[m] * w0 + c1[m] * w1).alias(m) for m in measures],
            F.col("_all").alias("support"),
        )

    half = F.lit(0.5)
    rows = F.concat(
        F.col("_c"),
        F.array(
            F.struct(
                F.lit("accuracy").alias("class"),
                *[F.col("_acc").alias(m) for m in measures],
                F.col("_all").alias("support"),
            ),
            average("macro avg", half, half),
            average(
                "weighted avg",
                ratio(c0["support"], F.col("_all")),
                ratio(c1["support"], F.col("_all")),
            ),
        ),
    )
    return per_class.select(F.explode(rows).alias("_r")).select("_r.*")


def operating_point(df: DataFrame, label: str = "y", flag: str = "flag") -> DataFrame:
    """False and true positive rate and precision of a flag, and the no-skill rate."""
    return metrics(df, label, flag).select(
        ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"),
        F.col("recall").alias("tpr"),
        "precision",
        ratio(
            F.col("tp") + F.col("fn"), F.col("tp") + F.col("fn") + F.col("tn") + F.col("fp")
        ).alias("no_skill"),
    )


def tidy_metrics(measured: DataFrame, names: Sequence[str] = ("precision", "recall", "f1", "accuracy")) -> DataFrame:
    """One row per metric from a one-row metrics table."""
    return measured.unpivot([], [F.col(n) for n in names], "metric", "value")


def metric_deltas(new: DataFrame, baseline: DataFrame) -> DataFrame:
    """Change of each metric against a stored run; both tables have (metric, value)."""
    old = baseline.select("metric", F.col("value").alias("baseline"))
    return new.select("metric", F.col("value").alias("current")).join(old, "metric").select(
        "metric",
        "baseline",
        "current",
        (F.col("current") - F.col("baseline")).alias("delta"),
        F.when(F.col("current") > F.col("baseline"), "^").otherwise("v").alias("direction"),
    )


def row_counts(df: DataFrame, label: str = "y", flag: str = "flag") -> DataFrame:
    """Rows and flagged rows per class."""
    return df.groupBy(F.col(label).alias("class")).agg(
        F.count(F.lit(1)).alias("n"), count_where(F.col(flag) == 1).alias("flagged")
    )


def two_stage_summary(name: str, routed: DataFrame, label: str = "y", flag: str = "flag") -> DataFrame:
    """One row: F1 of stage 1 and of the final decision, queue precision, fewer false alarms."""
    from flowsieve.operators.routing import QUEUE

    y, f, final, queued = F.col(label), F.col(flag), F.col("final"), F.col("route") == QUEUE
    counts = routed.agg(
        *[
            count_where(condition).alias(alias)
            for alias, condition in {
                "tp1": (y == 1) & (f == 1),
                "fp1": (y == 0) & (f == 1),
                "fn1": (y == 1) & (f == 0),
                "tp2": (y == 1) & (final == 1),
                "fp2": (y == 0) & (final == 1),
                "fn2": (y == 1) & (final == 0),
                "queued": queued,
                "queued_attacks": queued & (y == 1),
            }.items()
        ]
    )

    def f1(stage: int):
        tp = 2 * F.col(f"tp{stage}")
        return ratio(tp, tp + F.col(f"fp{stage}") + F.col(f"fn{stage}"))

    return counts.select(
        F.lit(name).alias("dataset"),
        f1(1).alias("stage1_f1"),
        f1(2).alias("final_f1"),
        (F.col("queued_attacks") / (F.col("queued") + F.lit(1e-9))).alias("queue_precision"),
        (1 - F.col("fp2") / F.greatest("fp1", F.lit(1))).alias("fp_reduction"),
    )


def score_label_correlation(df: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    return df.agg(F.corr(score, F.col(label).cast("double")).alias("correlation"))


def findings_document(
    findings: DataFrame, records: DataFrame, file: str, time: str = "ts"
) -> DataFrame:
    """The findings with what is said once per run: file, record count, time range, total.

    One row per finding, the finding nested as ``anomaly``, so that the list can grow with the data.
    The run's row is kept, with a NULL finding, if there are none.
    """
    from flowsieve.operators.windows import time_range

    entries = written(finding_records(findings, time), "findings")
    header, total = time_range(records, time).first(), entries.count()
    # Without an else the field can be NULL, in a run with findings too.
    nested = entries.select(F.when(F.lit(True), F.struct("*")).alias("anomaly"))
    if not total:
        kind = nested.schema["anomaly"].dataType
        nested = entries.sparkSession.range(1).select(F.lit(None).cast(kind).alias("anomaly"))
    return nested.select(
        F.lit(file).alias("file"),
        F.lit(header.records).cast("bigint").alias("records"),
        F.lit(header.time_range).cast("string").alias("time_range"),
        F.lit(total).cast("bigint").alias("total_anomalies"),
        "anomaly",
    )


def finding_records(findings: DataFrame, time: str = "ts") -> DataFrame:
    """Findings with formatted times, rounded scores and whole counts."""
    whole = [c for c in ("n_bytes", "n_packets", "n_dst_ports") if c in findings.columns]
    fine = [c for c in ("if_score", "failed_ratio") if c in findings.columns]
    other = [c for c in findings.columns if c not in {*whole, *fine, time}]
    return findings.select(
        F.date_format(time, "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        *other,
        *[F.round(c, 4).alias(c) for c in fine],
        *[F.col(c).cast("bigint").alias(c) for c in whole],
    )
