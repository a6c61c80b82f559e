"""Registered queries: detectors, classifiers and whole detection runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.catalog.views import (
    CLASSES,
    EVENT_FLAGGED,
    EVENT_SCORE_SET,
    EVENT_SCORES,
    HIDDEN,
    ORDER_FLOWS,
    STAGED,
    event_flags,
    forest_sql,
    r,
    rounded,
    scaled,
    sql,
    staged_flows,
    walk_sql,
)
from flowsieve.operators import curves, ensemble, iforest, lof, ordering, prep, recon, report, routing
from flowsieve.plans import detect
from flowsieve.session import written, written_lean
from flowsieve.sources import tables
from flowsieve.sources.flows import FEATURES, event_score_set, event_scores, order_flows, vectors

QUERIES = {}
SQL = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle:
            SQL[name] = oracle
        return function

    return register


TREES = iforest.TREES
SCALED = f"{ORDER_FLOWS}, {scaled('order_flows', 'z', FEATURES, 'flow_id', 'zero')}"
FOREST = f"{SCALED}, {forest_sql(TREES, FEATURES, 'z')}"
NAMES = "[" + ", ".join(f"'{f}'" for f in FEATURES) + "]"
VALUES = "[" + ", ".join(f"f{k}" for k in range(len(FEATURES))) + "]"
# Normaliser of a 256-row sample: c(256).
EXPECTED = iforest.average_path(256)
PATHS = f"""
{FOREST}, {walk_sql(f"range({TREES})", FEATURES)},
paths AS (
  SELECT w8.id AS flow_id, sum(leaf_micro) / {iforest.MICRO * TREES}::DOUBLE AS mean_path,
         sum(length(bin(w8.node)) - 1) / {TREES}::DOUBLE AS mean_depth
  FROM w8 JOIN leaves USING (tree, node) GROUP BY w8.id)
"""


def flow_matrix(spark, folder):
    """The ten features, infinities and gaps as 0, standardised; written, as a fit reads it often."""
    df = written(order_flows(spark, folder).select("flow_id", "true_label", *FEATURES), "flows")
    fitted = prep.fit_prep(df, FEATURES, impute="zero", drop_constant=False, log_skewed=False)
    return written(fitted.transform(df, ["flow_id", "true_label"]), "matrix")


def flow_forest(matrix):
    return iforest.fit_forest(matrix, FEATURES, ["flow_id"])


@query(
    "d1_forest_nodes",
    sql(FOREST, body=f"""
    SELECT tree, node, n AS "rows", {NAMES}[pick + 1] AS feature, {r("threshold")},
           CAST(NULL AS BIGINT) AS leaf_micro FROM splits
    UNION ALL SELECT tree, node, n, NULL, NULL, leaf_micro FROM leaves"""),
)
def forest_nodes(spark, folder):
    return rounded(flow_forest(flow_matrix(spark, folder)).nodes)


@query(
    "d2_forest_scores",
    sql(PATHS, body=f"""
    SELECT flow_id, {r("mean_path", digits=9)}, {r(f"-pow(2.0::DOUBLE, -mean_path / {EXPECTED!r})", "if_score")} FROM paths"""),
)
def forest_scores(spark, folder):
    matrix = flow_matrix(spark, folder)
    scored = flow_forest(matrix).score(matrix, ["flow_id"])
    # Nine digits hold a mean path exactly: a sum of millionths over 200 trees.
    return rounded(
        scored.select("flow_id", "mean_path", F.round(-F.col("anomaly_score"), 6).alias("if_score")), 9
    )


@query("d3_flag_fraction", sql(EVENT_FLAGGED, body=f"SELECT id, {r('score')}, flag FROM flagged"))
def flag_fraction(spark, folder):
    return rounded(event_flags(spark, folder).select("id", "score", "flag"))


@query(
    "d3_forest_flags",
    sql(PATHS, body=f"""
    SELECT flow_id, CASE WHEN -mean_path > -(SELECT quantile_cont(mean_path, 0.4) FROM paths)
                         THEN 1 ELSE 0 END AS flag FROM paths"""),
)
def forest_flags(spark, folder):
    """The score is a strictly rising function of the mean path, which has no rounding of its own."""
    matrix = flow_matrix(spark, folder)
    paths = written(flow_forest(matrix).score(matrix, ["flow_id"]), "paths")
    return paths.select(
        "flow_id", iforest.flag_lowest(paths, "mean_path", 0.4).cast("int").alias("flag")
    )


@query(
    "d4_decision_boundary",
    sql(EVENT_FLAGGED, body=f"""
    SELECT 'flagged' AS case_name, {r("max(if_score) FILTER (flag = 1)", "boundary")} FROM flagged
    UNION ALL SELECT 'none, fixed', -0.05::DOUBLE
    UNION ALL SELECT 'none, lowest', {r("min(if_score)", "boundary")} FROM flagged"""),
)
def decision_boundary(spark, folder):
    flagged = event_flags(spark, folder)
    none = flagged.withColumn("flag", F.lit(0))
    cases = {
        "flagged": iforest.decision_boundary(flagged, "if_score", "flag"),
        "none, fixed": iforest.decision_boundary(none, "if_score", "flag", -0.05),
        "none, lowest": iforest.decision_boundary(none, "if_score", "flag"),
    }
    named = [df.select(F.lit(name).alias("case_name"), "boundary") for name, df in cases.items()]
    return rounded(named[0].unionByName(named[1]).unionByName(named[2]))


def lof_sql(source: str) -> str:
    """Equal rows stand together: ties go by the lowest id of the rows that are equal to a neighbour."""
    return f"""
    WITH v AS (SELECT id, x, min(id) OVER (PARTITION BY x) AS rep FROM ({source})),
    pairs AS (SELECT a.id, b.id AS other, b.rep, list_distance(a.x, b.x) AS dist
              FROM v a JOIN v b ON a.id <> b.id),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, rep, other) AS rn
                            FROM pairs) WHERE rn <= 20),
    reach AS (SELECT id, max(dist) AS k_dist FROM near GROUP BY id),
    density AS (SELECT near.id, 1 / (avg(greatest(reach.k_dist, near.dist)) + 1e-10) AS density
                FROM near JOIN reach ON near.other = reach.id GROUP BY near.id)
    SELECT near.id, {r("avg(o.density) / max(d.density)", "lof")}
    FROM near JOIN density o ON near.other = o.id JOIN density d ON near.id = d.id GROUP BY near.id"""


@query(
    "d5_local_outlier_factor", lof_sql("SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings")
)
def local_outlier_factor(spark, folder):
    return rounded(lof.local_outlier_factor(vectors(spark, folder), ["x"], "id"))


@query(
    "d5_local_outlier_factor_parts",
    lof_sql("SELECT p_partkey AS id, [p_size::DOUBLE, floor(p_retailprice / 100)] AS x FROM part"),
)
def local_outlier_factor_parts(spark, folder):
    """Two coarse dimensions, so that many rows coincide."""
    parts = tables.table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_size").cast("double").alias("size"),
        F.floor(F.col("p_retailprice") / 100).cast("double").alias("price"),
    )
    return rounded(lof.local_outlier_factor(parts, ["size", "price"], "id"))


def vector_width(base) -> int:
    """Dimensions of the vectors, which must all have the same number."""
    row = base.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if row.least != row.most:
        raise ValueError(f"vectors have {row.least} to {row.most} dimensions")
    return row.most


def vector_errors(spark, folder):
    """Embedding dimensions as columns, with the error left by the components of the benign rows."""
    base = vectors(spark, folder)
    size = vector_width(base)
    names = [f"x{i}" for i in range(size)]
    wide = base.select("id", "y", *[F.col("x")[i].alias(c) for i, c in enumerate(names)])
    detector = recon.fit_reconstruction(wide.filter("y = 0"), names)
    return detector.score(wide).select("id", "y", "recon_error")


@query("d6_reconstruction_error")
def reconstruction_error(spark, folder):
    return rounded(vector_errors(spark, folder))


@query("d6_curved_reconstruction")
def curved_reconstruction(spark, folder):
    """Errors of the curved form on the flow table, fitted on its benign rows."""
    df = written(order_flows(spark, folder).select("flow_id", "true_label", *FEATURES), "flows")
    fitted = prep.fit_prep(df, FEATURES)
    matrix = written(fitted.transform(df, ["flow_id", "true_label"]), "matrix")
    detector = recon.fit_curved_reconstruction(matrix.filter("true_label = 0"), fitted.kept)
    return rounded(detector.score(matrix).select("flow_id", "true_label", "recon_error"))


@query(
    "d7_benign_percentile_flag",
    sql(EVENT_SCORES, body="""
    SELECT id, CASE WHEN score > (SELECT quantile_cont(score, 0.95) FROM event_scores WHERE y = 0)
                    THEN 1 ELSE 0 END AS flag FROM event_scores"""),
)
def benign_percentile_flag(spark, folder):
    df = event_scores(spark, folder)
    limit = recon.boundary(df.filter("y = 0"), "score")
    return df.select("id", recon.flag_above(limit, "score").alias("flag"))


@query("d7_reconstruction_flags")
def reconstruction_flags(spark, folder):
    errors = written(vector_errors(spark, folder), "errors")
    limit = recon.boundary(errors.filter("y = 0"))
    return report.row_counts(errors.withColumn("flag", recon.flag_above(limit)))


def norm_sql(column: str) -> str:
    return (
        f"({column} - (SELECT min({column}) FROM event_score_set)) / ((SELECT max({column}) - "
        f"min({column}) FROM event_score_set) + 1e-9)"
    )


SCORES = ["if_score", "lof_score", "recon_score"]


@query(
    "d8_normalise",
    sql(EVENT_SCORE_SET, body=f"SELECT id, {', '.join(r(norm_sql(c), c + '_norm') for c in SCORES)} FROM event_score_set"),
)
def normalise(spark, folder):
    df = ensemble.normalise(event_score_set(spark, folder), SCORES)
    return rounded(df.select("id", *[f"{c}_norm" for c in SCORES]))


@query(
    "d9_mean_ensemble",
    sql(EVENT_SCORE_SET, body=f"SELECT id, {r('(' + ' + '.join(norm_sql(c) for c in SCORES) + ') / 3', 'ensemble')} FROM event_score_set"),
)
def mean_ensemble(spark, folder):
    df = ensemble.mean_score(event_score_set(spark, folder), SCORES)
    return rounded(df.select("id", "ensemble"))


@query(
    "d10_flag_top",
    sql(EVENT_SCORES, body="""
    SELECT id, CASE WHEN row_number() OVER (ORDER BY score DESC, id)
                      <= floor(0.40 * (SELECT count(*) FROM event_scores)) THEN 1 ELSE 0 END AS flag
    FROM event_scores"""),
)
def flag_top(spark, folder):
    return ensemble.flag_top(event_scores(spark, folder), "score", "id", 0.40).select("id", "flag")


TEXT_IDS = """
    SELECT name, kind, CASE WHEN row_number() OVER (ORDER BY step DESC, {order})
                              <= floor(0.40 * count(*) OVER ()) THEN 1 ELSE 0 END AS flag
    FROM (SELECT 'event-' || event_id AS name, event_type AS kind, floor(value / 40) AS step FROM events)"""


def stepped_events(spark, folder):
    """Events with a text for an id, and so few different scores that ids decide."""
    return tables.table(spark, folder, "events").select(
        F.concat(F.lit("event-"), F.col("event_id")).alias("name"),
        F.col("event_type").alias("kind"),
        F.floor(F.col("value") / 40).alias("step"),
    )


@query("d10_flag_top_text_ids", TEXT_IDS.format(order="name"))
def flag_top_text_ids(spark, folder):
    df = written(stepped_events(spark, folder), "stepped")
    return ensemble.flag_top(df, "step", "name", 0.40).select("name", "kind", "flag")


@query("d10_flag_top_two_ids", TEXT_IDS.format(order="kind, name"))
def flag_top_two_ids(spark, folder):
    """Ids of two columns, compared one after the other."""
    df = written(stepped_events(spark, folder), "stepped")
    return ensemble.flag_top(df, "step", ["kind", "name"], 0.40).select("name", "kind", "flag")


@query(
    "d11_trace_paths",
    sql(FOREST, walk_sql("[0]", FEATURES), "steps AS (" + " UNION ALL ".join(
        f"SELECT id, tree, node, {level + 1} AS step FROM w{level}" for level in range(8)) + ")",
        body=f"""
    SELECT id AS flow_id, step, steps.node, {NAMES}[pick + 1] AS feature, {r("threshold")},
           {r(f"{VALUES}[pick + 1]", "value")},
           CASE WHEN {VALUES}[pick + 1] > threshold THEN 'right' ELSE 'left' END AS went
    FROM steps JOIN splits USING (tree, node) JOIN m USING (id)"""),
)
def trace_paths(spark, folder):
    matrix = flow_matrix(spark, folder)
    traced = iforest.trace_paths(matrix, flow_forest(matrix), 0, ["flow_id"])
    return rounded(traced.select("flow_id", F.explode("splits").alias("s")).select("flow_id", "s.*"))


@query("d12_mean_depth", sql(PATHS, body=f"SELECT flow_id, {r('mean_depth', digits=9)} FROM paths"))
def mean_depth(spark, folder):
    matrix = flow_matrix(spark, folder)
    return rounded(flow_forest(matrix).mean_depth(matrix, ["flow_id"]), 9)


@query(
    "d13_split_counts",
    sql(FOREST, body=f"""
    SELECT tree, {", ".join(f"count(*) FILTER (pick = {k}) AS {f}" for k, f in enumerate(FEATURES))},
           count(*) AS splits FROM splits GROUP BY ROLLUP (tree)"""),
)
def split_counts(spark, folder):
    return iforest.split_counts(flow_forest(flow_matrix(spark, folder)))


def flow_split(spark, folder, category: bool):
    """Order flows, 70 % to train and 30 % to test, stratified by the label or the class."""
    name = F.col("category") if category else F.lit("Attack")
    flows = order_flows(spark, folder).withColumn(
        "attack_cat", F.when(F.col("true_label") == 0, routing.NORMAL).otherwise(name)
    ).withColumnRenamed("true_label", "y")
    quota = F.floor(F.lit(0.3) * F.col("group_rows"))
    marked = ordering.hash_quota(flows, ["flow_id"], quota, by=["attack_cat"], name="is_test")
    marked = written(marked, "split")
    return marked.filter("not is_test"), marked.filter("is_test")


# Rounds for each class where there are more than two: with six classes these are 300 trees.
CLASS_ROUNDS = 50


def run_two_stage(spark, folder, category, hidden, limit, rounds):
    train, test = flow_split(spark, folder, category)
    model = detect.fit_two_stage(train, FEATURES, "y", "attack_cat", hidden, rounds=rounds)
    routed = model.run(test, ["flow_id", "y", "attack_cat"], limit)
    return routed.withColumnRenamed("attack_cat", "category")


@query("d14_two_class_stage")
def two_class_stage(spark, folder):
    """Detector, 200 rounds of boosted trees on its flags, routes of the test rows."""
    routed = run_two_stage(spark, folder, False, (), routing.CONFIDENCE, 200)
    return rounded(routed.select("flow_id", "y", "recon_error", "flag", "predicted", "confidence", "route", "final"))


@query("d15_many_class_stage")
def many_class_stage(spark, folder):
    """The same with all attack classes, each boosted against the rest."""
    routed = run_two_stage(spark, folder, True, (), routing.CONFIDENCE, CLASS_ROUNDS)
    return rounded(routed.select("flow_id", "y", "category", "flag", "predicted", "confidence", "route", "final"))


@query("d15_class_hold_out_run")
def class_hold_out_run(spark, folder):
    """Stage 2 never sees the hidden classes; how many of their rows reach the review queue."""
    routed = run_two_stage(spark, folder, True, HIDDEN, routing.HOLD_OUT_CONFIDENCE, CLASS_ROUNDS)
    return rounded(routing.hidden_detection(routed, HIDDEN))


@query("d16_confidence", sql(STAGED, body=f"SELECT id, predicted, {r('confidence')} FROM staged"))
def confidence(spark, folder):
    df = staged_flows(spark, folder)
    names = F.array(*[F.lit(c) for c in CLASSES])
    return rounded(
        df.select(
            "id",
            routing.predicted_class(F.col("probabilities"), names).alias("predicted"),
            routing.confidence(F.col("probabilities")).alias("confidence"),
        )
    )


@query("detector_comparison")
def detector_comparison(spark, folder):
    """Forest, local outlier factor and reconstruction on the vectors, and their mean, by KS."""
    base = vectors(spark, folder)
    size = vector_width(base)
    names = [f"x{i}" for i in range(size)]
    wide = base.select("id", "y", *[F.col("x")[i].alias(c) for i, c in enumerate(names)])
    scored = written_lean(detect.detector_scores(wide, names, "id", "y"), "compared")
    measured = curves.separation(scored, ["if_score", "lof_score", "recon_score", "ensemble"])
    return rounded(curves.rank_detectors(measured, "if_score"))


@query("detector_comparison_flows")
def detector_comparison_flows(spark, folder):
    """The same comparison on the flow table."""
    flows = written_lean(order_flows(spark, folder).select("flow_id", "true_label", *FEATURES), "flows")
    scored = written_lean(detect.detector_scores(flows, FEATURES, "flow_id", "true_label"), "compared")
    measured = curves.separation(
        scored, ["if_score", "lof_score", "recon_score", "ensemble"], label="true_label"
    )
    return rounded(curves.rank_detectors(measured, "if_score"))


@query("f24_fitted_two_stage")
def fitted_two_stage(spark, folder):
    """The summary of a run whose detector and second stage were fitted here."""
    routed = run_two_stage(spark, folder, True, (), routing.CONFIDENCE, CLASS_ROUNDS)
    return rounded(report.two_stage_summary("flows", routed))
