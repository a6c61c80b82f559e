"""Registered queries: confusion counts, curves, distributions and detector overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.catalog.respond import routed_flows
from flowsieve.catalog.views import (
    EVENT_FLAGGED,
    EVENT_SCORE_SET,
    EVENT_SCORES,
    ORDER_FLOWS,
    event_flags,
    r,
    rounded,
    routed,
    routes,
    sql,
)
from flowsieve.operators import curves, distributions, ensemble, report, routing
from flowsieve.session import written
from flowsieve.sources.flows import event_score_set, event_scores, order_flows

QUERIES = {}
SQL = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle:
            SQL[name] = oracle
        return function

    return register


COUNTS = """
counts AS (SELECT count(*) FILTER (y = 0 AND flag = 0) AS tn, count(*) FILTER (y = 0 AND flag = 1) AS fp,
                  count(*) FILTER (y = 1 AND flag = 0) AS fn, count(*) FILTER (y = 1 AND flag = 1) AS tp
           FROM flagged)
"""


def div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0 ELSE ({a})::DOUBLE / ({b}) END"


METRICS = f"""
measures AS (SELECT *, {div("tp", "tp + fp")} AS precision, {div("tp", "tp + fn")} AS recall,
                    {div("2 * tp", "2 * tp + fp + fn")} AS f1,
                    {div("tp + tn", "tp + tn + fp + fn")} AS accuracy FROM counts)
"""


@query("f1_confusion", sql(EVENT_FLAGGED, COUNTS, body="SELECT tn, fp, fn, tp FROM counts"))
def confusion(spark, folder):
    return report.confusion(event_flags(spark, folder))


def class_sql(hit: str, wrong: str, missed: str, name: str) -> str:
    return (
        f"SELECT '{name}' AS \"class\", {div(hit, f'{hit} + {wrong}')} AS precision, "
        f"{div(hit, f'{hit} + {missed}')} AS recall, "
        f"{div(f'2 * {hit}', f'2 * {hit} + {wrong} + {missed}')} AS f1, {hit} + {missed} AS support FROM counts"
    )


@query(
    "f2_classification_report",
    sql(EVENT_FLAGGED, COUNTS, METRICS,
        f"per AS ({class_sql('tn', 'fn', 'fp', '0')} UNION ALL {class_sql('tp', 'fp', 'fn', '1')})", f"""
    rep AS (
      SELECT * FROM per UNION ALL
      SELECT 'accuracy', accuracy, accuracy, accuracy, tn + fp + fn + tp FROM measures UNION ALL
      SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per UNION ALL
      SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
             sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per)""",
        body=f'SELECT "class", {r("precision")}, {r("recall")}, {r("f1")}, support FROM rep'),
)
def classification_report(spark, folder):
    return rounded(report.classification_report(event_flags(spark, folder)))


@query(
    "f3_metrics",
    sql(EVENT_FLAGGED, COUNTS, METRICS, body=f"""
    SELECT tn, fp, fn, tp, {r("precision")}, {r("recall")}, {r("f1")}, {r("accuracy")} FROM measures"""),
)
def metrics(spark, folder):
    return rounded(report.metrics(event_flags(spark, folder)))


RANKED = f"""
{EVENT_SCORES},
per_score AS (SELECT score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg
              FROM event_scores GROUP BY score),
ranked AS (SELECT score AS threshold, pos, neg,
                  CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp,
                  CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp,
                  CAST(sum(pos) OVER () AS BIGINT) AS positives,
                  CAST(sum(neg) OVER () AS BIGINT) AS negatives FROM per_score)
"""
POINT = f"{div('tp', 'tp + fp')} AS p, {div('tp', 'positives')} AS rec, {div('fp', 'negatives')} AS fpr"
POINTS = f"{RANKED}, points AS (SELECT *, {POINT} FROM ranked)"


def ranked_events(spark, folder):
    return curves.ranked_counts(event_scores(spark, folder))


@query(
    "f4_roc_points",
    sql(POINTS, body=f"""
    SELECT {r("threshold")}, {r("fpr")}, {r("rec", "tpr")} FROM points
    UNION ALL SELECT NULL, 0.0::DOUBLE, 0.0::DOUBLE"""),
)
def roc_points(spark, folder):
    return rounded(curves.roc_curve(ranked_events(spark, folder)))


AUC = "sum(pos * (negatives - fp + neg / 2.0::DOUBLE)) / (max(positives)::DOUBLE * max(negatives))"


@query("f5_roc_auc", sql(POINTS, body=f"SELECT {r(AUC, 'auc')} FROM points"))
def roc_auc(spark, folder):
    return rounded(curves.roc_auc(ranked_events(spark, folder)))


@query(
    "f6_precision_recall_points",
    sql(POINTS, body=f"""
    SELECT {r("threshold")}, {r("p", "precision")}, {r("rec", "recall")} FROM points
    UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE"""),
)
def precision_recall_points(spark, folder):
    return rounded(curves.precision_recall_curve(ranked_events(spark, folder)))


@query(
    "f7_average_precision",
    sql(POINTS, "steps AS (SELECT p, rec - coalesce(lag(rec) OVER (ORDER BY threshold DESC), 0) AS gain FROM points)",
        body=f"SELECT {r('sum(p * gain)', 'average_precision')} FROM steps"),
)
def average_precision(spark, folder):
    return rounded(curves.average_precision(ranked_events(spark, folder)))


@query(
    "f8_best_f1",
    sql(POINTS, "f AS (SELECT *, 2 * p * rec / greatest(p + rec, 1e-9) AS f1 FROM points)", body=f"""
    SELECT {r("threshold")}, {r("p", "precision")}, {r("rec", "recall")}, {r("f1")} FROM f
    ORDER BY f.f1 DESC, f.threshold LIMIT 1"""),
)
def best_f1(spark, folder):
    return rounded(curves.best_f1(ranked_events(spark, folder)))


@query(
    "f9_ks_distance",
    sql(POINTS, body=f"""
    SELECT {r("abs(rec - fpr)", "ks")}, {r("threshold")} FROM points
    ORDER BY abs(rec - fpr) DESC, points.threshold LIMIT 1"""),
)
def ks_distance(spark, folder):
    return rounded(curves.ks_distance(ranked_events(spark, folder)))


@query(
    "f10_overlap_verdict",
    sql(POINTS, body=f"""
    SELECT {r("max(abs(rec - fpr))", "ks")}, CASE WHEN max(abs(rec - fpr)) < 0.5
             THEN 'overlap is structural' ELSE 'threshold can help' END AS verdict FROM points"""),
)
def overlap_verdict(spark, folder):
    return rounded(curves.overlap_verdict(curves.ks_distance(ranked_events(spark, folder))))


GRID = f"""
{EVENT_SCORES},
ends AS (SELECT quantile_cont(score, 0.005) AS lo, quantile_cont(score, 0.995) AS hi FROM event_scores),
sizes AS (SELECT count(*) FILTER (y = 1) AS np, count(*) FILTER (y = 0) AS nn FROM event_scores),
spaced AS (SELECT unnest(range(400)) AS point),
grid AS (SELECT point, lo + point * ((hi - lo) / 399) AS score FROM spaced, ends),
placed AS (SELECT greatest(ceil((score - lo) / ((hi - lo) / 399)), 0)::BIGINT AS point, y
           FROM event_scores, ends),
at_point AS (SELECT point, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n
             FROM placed GROUP BY point),
cdf AS (SELECT point, score, sum(coalesce(p, 0)) OVER (ORDER BY point) / np::DOUBLE AS cdf_positive,
               sum(coalesce(n, 0)) OVER (ORDER BY point) / nn::DOUBLE AS cdf_negative
        FROM grid LEFT JOIN at_point USING (point), sizes)
"""


@query(
    "f11_cdf_grid",
    sql(GRID, body=f"""
    SELECT point, {r("score")}, {r("cdf_positive")}, {r("cdf_negative")},
           {r("abs(cdf_positive - cdf_negative)", "gap")} FROM cdf"""),
)
def cdf_grid(spark, folder):
    return rounded(distributions.cdf_grid(event_scores(spark, folder)))


@query(
    "f11_widest_gap",
    sql(GRID, body=f"""
    SELECT point, {r("score")}, {r("abs(cdf_positive - cdf_negative)", "gap")} FROM cdf
    ORDER BY abs(cdf_positive - cdf_negative) DESC, point LIMIT 1"""),
)
def widest_gap(spark, folder):
    return rounded(distributions.widest_gap(distributions.cdf_grid(event_scores(spark, folder))))


HISTOGRAM = f"""
{EVENT_SCORES},
ends AS (SELECT min(score) AS lo, (max(score) - min(score)) / 60 AS w FROM event_scores),
binned AS (SELECT y AS "class", CAST(least(floor((score - lo) / w), 59) AS INT) AS bin,
                  count(*) AS n FROM event_scores, ends GROUP BY ALL),
hist AS (SELECT "class", bin, lo + bin * w AS bin_start, n,
                n / (sum(n) OVER (PARTITION BY "class") * w) AS density FROM binned, ends)
"""


@query(
    "f12_histogram",
    sql(HISTOGRAM, body=f'SELECT "class", bin, {r("bin_start")}, n, {r("density", digits=9)} FROM hist'),
)
def histogram(spark, folder):
    df = distributions.histogram(event_scores(spark, folder), "score", "y", 60)
    return rounded(df.withColumn("bin_start", F.round("bin_start", 6)), 9)


@query(
    "f13_density_overlap",
    sql(HISTOGRAM, """
    sides AS (SELECT bin, max(CASE WHEN "class" = 1 THEN density ELSE 0 END) AS positive,
                    max(CASE WHEN "class" = 0 THEN density ELSE 0 END) AS negative
             FROM hist GROUP BY bin)""", body=f"""
    SELECT bin, {r("positive", digits=9)}, {r("negative", digits=9)},
           {r("least(positive, negative)", "overlap", 9)} FROM sides"""),
)
def density_overlap(spark, folder):
    counts = distributions.histogram(event_scores(spark, folder), "score", "y", 60)
    return rounded(distributions.density_overlap(counts), 9)


@query(
    "f14_kernel_density",
    sql(EVENT_SCORES, """
    stats AS (SELECT y, count(*) AS n, min(score) AS lo, max(score) AS hi,
                     stddev_samp(score) * 0.15 AS h FROM event_scores GROUP BY y),
    weights AS (SELECT y, score, count(*) AS w FROM event_scores GROUP BY y, score),
    spaced AS (SELECT unnest(range(300)) AS point),
    dense AS (SELECT y AS "class", point, lo + point * (hi - lo) / 299 AS "at",
                     sum(w * exp(-0.5 * ((lo + point * (hi - lo) / 299 - score) / h) ** 2))
                       / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS density
              FROM weights JOIN stats USING (y), spaced GROUP BY ALL)""",
    body=f"""SELECT "class", CAST(point AS INT) AS point, {r('"at"')}, {r("density", digits=9)} FROM dense"""),
)
def kernel_density(spark, folder):
    df = distributions.kernel_density(event_scores(spark, folder))
    return rounded(df.withColumn("at", F.round("at", 6)), 9)


SWEEP = f"""
{EVENT_SCORES},
ordered AS (SELECT y, -score AS s, row_number() OVER (ORDER BY -score, id) - 1 AS k FROM event_scores),
steps AS (SELECT i AS step, (i + 1) * 5 AS pct FROM unnest(range(15)) AS u(i)),
cuts AS (SELECT step, pct, s AS cut FROM steps JOIN ordered
         ON k = floor((SELECT count(*) FROM event_scores) * pct / 100.0)),
swept AS (SELECT step, pct / 100.0::DOUBLE AS share, count(*) FILTER (s <= cut AND y = 1) AS tp,
                 count(*) FILTER (s <= cut AND y = 0) AS fp, count(*) FILTER (s > cut AND y = 1) AS fn
          FROM cuts, ordered GROUP BY ALL),
rates AS (SELECT *, tp / (tp + fp + 1e-9) AS p, tp / (tp + fn + 1e-9) AS rec FROM swept),
scored AS (SELECT *, 2 * p * rec / (p + rec + 1e-9) AS f1 FROM rates)
"""


def sweep_table(spark, folder):
    df = event_scores(spark, folder).select("y", (-F.col("score")).alias("if_score"))
    return distributions.threshold_sweep(df)


@query(
    "f15_threshold_sweep",
    sql(SWEEP, body=f"""
    SELECT step, {r("share")}, tp, fp, fn, {r("p", "precision")}, {r("rec", "recall")}, {r("f1")}
    FROM scored"""),
)
def threshold_sweep(spark, folder):
    return rounded(sweep_table(spark, folder))


@query(
    "f16_best_of_sweep",
    sql(SWEEP, body=f"""
    SELECT {r("share")}, {r("f1")}, {r("from_share")}, {r("to_share")} FROM (
      SELECT *, coalesce(lag(share) OVER o, share) AS from_share,
             coalesce(lead(share) OVER o, share) AS to_share
      FROM scored WINDOW o AS (ORDER BY step)) s ORDER BY s.f1 DESC, step LIMIT 1"""),
)
def best_of_sweep(spark, folder):
    return rounded(distributions.best_of_sweep(sweep_table(spark, folder)))


EFFECTS = ["fwd_bytes", "bwd_bytes", "syn_flag", "rst_flag", "fin_flag", "ack_flag", "pkt_len_mean",
           "pkt_len_std", "flow_pkts_s"]


@query(
    "f17_cohens_d",
    sql(ORDER_FLOWS, "effects AS (" + " UNION ALL ".join(f"""
    SELECT '{c}' AS feature, avg({c}) FILTER (true_label = 1) AS m1, avg({c}) FILTER (true_label = 0) AS m0,
           sqrt((var_pop({c}) FILTER (true_label = 1) + var_pop({c}) FILTER (true_label = 0)) / 2) + 1e-9
             AS pooled FROM order_flows""" for c in EFFECTS) + ")", body=f"""
    SELECT feature, {r("m1", "mean_positive", 5)}, {r("m0", "mean_negative", 5)},
           {r("(m1 - m0) / pooled", "d", 5)},
           CASE WHEN m1 > m0 THEN 'positive' ELSE 'negative' END AS higher_in FROM effects"""),
)
def cohens_d(spark, folder):
    return rounded(distributions.cohens_d(order_flows(spark, folder), EFFECTS), 5)


@query(
    "f18_class_summary",
    sql(EVENT_SCORES, body=f"""
    SELECT y AS "class", count(*) AS n, {r("avg(score)", "mean")}, {r("stddev_samp(score)", "sd")},
           {r("median(score)", "median")} FROM event_scores GROUP BY y"""),
)
def class_summary(spark, folder):
    return rounded(distributions.class_summary(event_scores(spark, folder)))


BOXES = ["fwd_bytes", "flow_pkts_s", "rst_flag", "syn_flag"]


@query(
    "f19_box_summary",
    sql(ORDER_FLOWS, "logged AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, true_label AS \"class\", ln(1 + greatest({c}, 0)) AS v FROM order_flows"
        for c in BOXES) + ")", """
    quarts AS (SELECT feature, "class", quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
                      quantile_cont(v, 0.75) AS q3 FROM logged GROUP BY ALL)""", body=f"""
    SELECT feature, "class", {r("any_value(q1)", "q1")}, {r("any_value(median)", "median")},
           {r("any_value(q3)", "q3")},
           {r("min(v) FILTER (v >= q1 - 1.5 * (q3 - q1) - 1e-12)", "low_whisker")},
           {r("max(v) FILTER (v <= q3 + 1.5 * (q3 - q1) + 1e-12)", "high_whisker")},
           count(*) FILTER (v < q1 - 1.5 * (q3 - q1) - 1e-12 OR v > q3 + 1.5 * (q3 - q1) + 1e-12) AS outside
    FROM logged JOIN quarts USING (feature, "class") GROUP BY feature, "class\""""),
)
def box_summary(spark, folder):
    flows = written(order_flows(spark, folder).select("true_label", *BOXES), "flows")
    return rounded(distributions.box_summary(flows, BOXES))


DETECTORS = ["if_score", "lof_score", "recon_score"]
OVERLAP = f"""
{EVENT_SCORE_SET},
flags AS (SELECT y, {", ".join(
    f"row_number() OVER (ORDER BY {c} DESC, id) <= floor(0.40 * count(*) OVER ()) AS {c}" for c in DETECTORS)}
  FROM event_score_set),
caught AS (SELECT if_score AS a, lof_score AS b, recon_score AS c FROM flags WHERE y = 1)
"""


@query(
    "f20_detector_overlap",
    sql(OVERLAP, body=" UNION ALL ".join(
        f"SELECT '{name}' AS region, count(*) FILTER ({rule}) AS caught FROM caught"
        for name, rule in {
            "only if": "a AND NOT b AND NOT c", "only lof": "b AND NOT a AND NOT c",
            "only recon": "c AND NOT a AND NOT b", "if+lof": "a AND b AND NOT c",
            "if+recon": "a AND c AND NOT b", "lof+recon": "b AND c AND NOT a",
            "all": "a AND b AND c", "any": "a OR b OR c"}.items())),
)
def detector_overlap(spark, folder):
    df = written(event_score_set(spark, folder), "score-set")
    df = ensemble.flag_top_of(df, {c: c.removesuffix("_score") for c in DETECTORS}, "id", 0.40)
    return ensemble.detector_overlap(df, ["if", "lof", "recon"])


FIVE = {
    "high": "score", "low": "-score", "middle": "-abs(score - 50)",
    "late": "CAST(id AS DOUBLE)", "mixed": "score + CAST(id % 7 AS DOUBLE)",
}


@query(
    "f20_five_detectors",
    sql(EVENT_SCORES, f"""
    flags AS (SELECT y, {", ".join(
        f"CASE WHEN row_number() OVER (ORDER BY {rule} DESC, id) <= floor(0.10 * count(*) OVER ()) THEN {1 << i} ELSE 0 END AS {c}"
        for i, (c, rule) in enumerate(FIVE.items()))} FROM event_scores),
    masks AS (SELECT {" + ".join(FIVE)} AS mask FROM flags WHERE y = 1),
    names AS (SELECT * FROM (VALUES {", ".join(f"({1 << i}, '{c}')" for i, c in enumerate(FIVE))}) AS t(bit, detector)),
    regions AS (SELECT mask, CASE WHEN mask = 31 THEN 'all' WHEN count(*) = 1 THEN 'only ' || any_value(detector)
                                  ELSE string_agg(detector, '+' ORDER BY bit) END AS region
                FROM unnest(range(1, 32)) AS t(mask) JOIN names ON mask & bit <> 0 GROUP BY mask)""",
    body="""
    SELECT region, (SELECT count(*) FROM masks WHERE masks.mask = regions.mask) AS caught FROM regions
    UNION ALL SELECT 'any', count(*) FROM masks WHERE mask > 0"""),
)
def five_detectors(spark, folder):
    """Thirty-one combinations of five rankings of the events, from one selection and one count."""
    df = event_scores(spark, folder)
    df = written(df.select("id", "y", *[F.expr(rule).alias(c) for c, rule in FIVE.items()]), "five")
    return ensemble.detector_overlap(ensemble.flag_top_of(df, {c: f"{c} top" for c in FIVE}, "id", 0.10)
                                     .select("y", *[F.col(f"{c} top").alias(c) for c in FIVE]), list(FIVE))


def separation_sql(column: str) -> str:
    return f"""
    SELECT '{column}' AS detector, max(abs(tp / positives::DOUBLE - fp / negatives::DOUBLE)) AS ks,
           sum(pos * (negatives - fp + neg / 2.0::DOUBLE)) / (max(positives)::DOUBLE * max(negatives)) AS auc
    FROM (SELECT pos, neg, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp,
                 sum(pos) OVER () AS positives, sum(neg) OVER () AS negatives
          FROM (SELECT {column} AS s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg
                FROM event_score_set GROUP BY 1))"""


@query(
    "f21_rank_detectors",
    sql(EVENT_SCORE_SET, "measured AS (" + " UNION ALL ".join(separation_sql(c) for c in DETECTORS) + ")",
        body=f"""
    SELECT detector, {r("ks")}, {r("auc")},
           row_number() OVER (ORDER BY measured.ks DESC, detector) AS place,
           {r("measured.ks - (SELECT ks FROM measured WHERE detector = 'if_score')", "lift")}
    FROM measured"""),
)
def rank_detectors(spark, folder):
    measured = curves.separation(event_score_set(spark, folder), DETECTORS)
    return rounded(curves.rank_detectors(measured, "if_score"))


NAMES = ("precision", "recall", "f1", "accuracy")


def tidy_sql(cte: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS metric, {n} AS value FROM {cte}" for n in NAMES)


@query(
    "f22_metric_deltas",
    sql(EVENT_FLAGGED, COUNTS, METRICS, """
    other AS (SELECT y, CASE WHEN score > 80 THEN 1 ELSE 0 END AS flag FROM event_scores)""",
        COUNTS.replace("counts AS", "counts2 AS").replace("FROM flagged", "FROM other"),
        METRICS.replace("measures AS", "measures2 AS").replace("FROM counts", "FROM counts2"),
        f"old AS ({tidy_sql('measures')})", f"new AS ({tidy_sql('measures2')})", body=f"""
    SELECT metric, {r("old.value", "baseline")}, {r("new.value", "current")},
           {r("new.value - old.value", "delta")},
           CASE WHEN new.value > old.value THEN '^' ELSE 'v' END AS direction
    FROM old JOIN new USING (metric)"""),
)
def metric_deltas(spark, folder):
    """A fixed score cut against the stored metrics of the contamination cut."""
    stored = written(report.tidy_metrics(report.metrics(event_flags(spark, folder))), "baseline")
    cut = event_scores(spark, folder).withColumn("flag", (F.col("score") > 80).cast("int"))
    return rounded(report.metric_deltas(report.tidy_metrics(report.metrics(cut)), stored))


@query(
    "f23_operating_point",
    sql(EVENT_FLAGGED, COUNTS, METRICS, body=f"""
    SELECT {r(div("fp", "fp + tn"), "fpr")}, {r("recall", "tpr")}, {r("precision")},
           {r(div("tp + fn", "tp + fn + tn + fp"), "no_skill")} FROM measures"""),
)
def operating_point(spark, folder):
    return rounded(report.operating_point(event_flags(spark, folder)))


SUMMARY = """
SELECT '{name}' AS dataset, {f1} AS stage1_f1, {f2} AS final_f1, {p} AS queue_precision,
       {red} AS fp_reduction FROM (
  SELECT count(*) FILTER (y = 1 AND flag = 1) AS tp1, count(*) FILTER (y = 0 AND flag = 1) AS fp1,
         count(*) FILTER (y = 1 AND flag = 0) AS fn1, count(*) FILTER (y = 1 AND final = 1) AS tp2,
         count(*) FILTER (y = 0 AND final = 1) AS fp2, count(*) FILTER (y = 1 AND final = 0) AS fn2,
         count(*) FILTER (route = 'ZERO_DAY_QUEUE') AS q,
         count(*) FILTER (route = 'ZERO_DAY_QUEUE' AND y = 1) AS qa FROM {source})
"""


def summary_sql(name: str, source: str) -> str:
    return SUMMARY.format(
        name=name, source=source,
        f1=div("2 * tp1", "2 * tp1 + fp1 + fn1"), f2=div("2 * tp2", "2 * tp2 + fp2 + fn2"),
        p="qa / (q + 1e-9)", red="1 - fp2 / greatest(fp1, 1)::DOUBLE",
    )


@query(
    "f24_two_stage_summary",
    sql(routed(0.60), routes(0.55, "routed2"), "summaries AS (" + summary_sql("limit 0.60", "routed") + " UNION ALL "
        + summary_sql("limit 0.55", "routed2") + ")", body=f"""
    SELECT dataset, {r("stage1_f1")}, {r("final_f1")}, {r("queue_precision")}, {r("fp_reduction")} FROM summaries"""),
)
def two_stage_summary(spark, folder):
    rows = [
        report.two_stage_summary(f"limit {limit:.2f}", routed_flows(spark, folder, limit))
        for limit in (routing.CONFIDENCE, routing.HOLD_OUT_CONFIDENCE)
    ]
    return rounded(rows[0].unionByName(rows[1]))


@query(
    "f25_score_label_correlation",
    sql(EVENT_SCORES, body=f"SELECT {r('corr(score, y)', 'correlation')} FROM event_scores"),
)
def score_label_correlation(spark, folder):
    return rounded(report.score_label_correlation(event_scores(spark, folder)))
