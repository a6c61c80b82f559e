"""The forest on every numeric column: medians, constants dropped, right tails logged, best cut."""

from __future__ import annotations

from flowsieve.catalog.detect import EXPECTED, TREES
from flowsieve.catalog.views import ORDER_FLOWS, finite, forest_sql, r, rounded, sql, walk_sql
from flowsieve.operators import curves, iforest
from flowsieve.plans import detect
from flowsieve.session import written
from flowsieve.sources.flows import FEATURES, order_flows
from pyspark.sql import functions as F

QUERIES = {}
SQL = {}

VARYING = [*FEATURES, "fwd_pkts", "bwd_pkts", "ack_flag", "pkt_len_std"]
COLUMNS = [*VARYING, "const_col"]


def _skew(column: str) -> str:
    mean = f"(SELECT avg({column}) FROM filled)"
    return (
        f"avg(({column} - {mean}) ** 3) / avg(({column} - {mean}) ** 2) ** 1.5 "
        "* sqrt(count(*)::DOUBLE * (count(*) - 1)) / (count(*) - 2)"
    )


SCORES = f"""
{ORDER_FLOWS},
raw AS (SELECT flow_id, true_label, {", ".join(f"{finite(c)} AS {c}" for c in VARYING)} FROM order_flows),
filled AS MATERIALIZED (
  SELECT flow_id, true_label, {", ".join(f"coalesce({c}, (SELECT median({c}) FROM raw)) AS {c}" for c in VARYING)}
  FROM raw),
skews AS MATERIALIZED (SELECT {", ".join(f"{_skew(c)} AS g_{c}" for c in VARYING)} FROM filled),
shaped AS MATERIALIZED (
  SELECT flow_id, {", ".join(f"CASE WHEN g_{c} > 2 THEN ln(1 + greatest({c}, 0)) ELSE {c} END AS {c}" for c in VARYING)}
  FROM filled, skews),
moments AS MATERIALIZED (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in VARYING)} FROM shaped),
z AS (SELECT flow_id, {", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in VARYING)} FROM shaped, moments),
{forest_sql(TREES, VARYING, "z")}, {walk_sql(f"range({TREES})", VARYING)},
scores AS (
  SELECT w8.id AS flow_id, -pow(2.0::DOUBLE, -sum(leaf_micro) / {iforest.MICRO * TREES}::DOUBLE
                                             / {EXPECTED!r}) AS if_score
  FROM w8 JOIN leaves USING (tree, node) GROUP BY w8.id)
"""


def scored(spark, folder):
    flows = written(order_flows(spark, folder), "flows")
    return written(
        detect.forest_scores(
            flows, COLUMNS, "flow_id", impute="median", log_skewed=True, drop_constant=True, two_sided=False
        ),
        "scored",
    )


def all_columns(spark, folder):
    return rounded(scored(spark, folder).select("flow_id", "if_score"))


QUERIES["d2_all_columns"] = all_columns
SQL["d2_all_columns"] = sql(SCORES, body=f"SELECT flow_id, {r('if_score')} FROM scores")


def best_cut(spark, folder):
    """The cut with the highest F1 on the precision-recall curve of the scores, turned round."""
    turned = scored(spark, folder).select(F.col("true_label").alias("y"), (-F.col("if_score")).alias("score"))
    return rounded(curves.best_f1(curves.ranked_counts(turned)))


QUERIES["f8_all_columns_cut"] = best_cut
SQL["f8_all_columns_cut"] = sql(
    SCORES,
    """
per AS (SELECT -if_score AS threshold, count(*) FILTER (true_label = 1) AS pos, count(*) AS n
        FROM scores JOIN order_flows USING (flow_id) GROUP BY if_score),
upto AS (SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC) AS tp,
                sum(n) OVER (ORDER BY threshold DESC) AS flagged, sum(pos) OVER () AS positives FROM per),
points AS (SELECT threshold, tp / flagged::DOUBLE AS p, tp / positives::DOUBLE AS rec FROM upto)""",
    body=f"""
    SELECT {r("threshold")}, {r("p", "precision")}, {r("rec", "recall")},
           {r("2 * p * rec / greatest(p + rec, 1e-9)", "f1")} FROM points
    ORDER BY 2 * p * rec / greatest(p + rec, 1e-9) DESC, points.threshold LIMIT 1""",
)
