"""The queries that sort or rank, registered again with a tiny limit on what one task may sort.

At the usual limit small tables never reach the split paths; here every table does.
"""

from __future__ import annotations

from flowsieve.catalog import detect, evaluate, prepare, respond
from flowsieve.catalog.views import rounded
from flowsieve.operators import curves, ensemble
from flowsieve.session import TASK_ROWS_SETTING
from flowsieve.sources.flows import event_scores
from pyspark.sql import functions as F

LIMIT = 50

QUERIES = {}
SQL = {}

AS_THEY_ARE = {
    prepare: ["c5_median_impute", "c6_own_medians", "c12_winsorise", "c12_winsorise_users", "c14_encode_names"],
    detect: [
        "d3_flag_fraction", "d7_benign_percentile_flag", "d10_flag_top_text_ids", "d10_flag_top_two_ids",
    ],
    evaluate: [
        "f5_roc_auc", "f7_average_precision", "f9_ks_distance", "f11_cdf_grid", "f15_threshold_sweep",
        "f18_class_summary", "f19_box_summary", "f20_detector_overlap", "f20_five_detectors", "f21_rank_detectors",
    ],
    respond: ["e3_finding_types"],
}


def limited(function):
    """The query built in a session whose tasks may sort ``LIMIT`` rows."""

    def run(spark, folder):
        spark.conf.set(TASK_ROWS_SETTING, str(LIMIT))
        try:
            return function(spark, folder)
        finally:
            spark.conf.unset(TASK_ROWS_SETTING)

    run.__doc__ = function.__doc__
    return run


for section, names in AS_THEY_ARE.items():
    for name in names:
        QUERIES[f"{name}_bucketed"] = limited(section.QUERIES[name])
        SQL[f"{name}_bucketed"] = section.SQL[name]


def with_nulls(spark, folder):
    """Event scores, one in fifty of them missing."""
    return event_scores(spark, folder).withColumn("score", F.when(F.col("id") % 50 != 0, F.col("score")))


def sql_with_nulls(text: str) -> str:
    changed = text.replace("value AS score", "CASE WHEN event_id % 50 <> 0 THEN value END AS score")
    assert changed != text
    return changed


def ranked(spark, folder):
    return curves.ranked_counts(with_nulls(spark, folder))


QUERIES["f4_roc_points_bucketed"] = limited(lambda s, d: rounded(curves.roc_curve(ranked(s, d))))
SQL["f4_roc_points_bucketed"] = sql_with_nulls(evaluate.SQL["f4_roc_points"])
QUERIES["f6_precision_recall_points_bucketed"] = limited(
    lambda s, d: rounded(curves.precision_recall_curve(ranked(s, d)))
)
SQL["f6_precision_recall_points_bucketed"] = sql_with_nulls(evaluate.SQL["f6_precision_recall_points"])
QUERIES["f8_best_f1_bucketed"] = limited(lambda s, d: rounded(curves.best_f1(ranked(s, d))))
SQL["f8_best_f1_bucketed"] = sql_with_nulls(evaluate.SQL["f8_best_f1"])
QUERIES["d10_flag_top_bucketed"] = limited(
    lambda s, d: ensemble.flag_top(with_nulls(s, d), "score", "id", 0.40).select("id", "flag")
)
SQL["d10_flag_top_bucketed"] = sql_with_nulls(detect.SQL["d10_flag_top"]).replace(
    "SELECT count(*) FROM event_scores", "SELECT count(score) FROM event_scores"
)
