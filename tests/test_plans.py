"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from flowsieve.operators import curves, iforest, ordering, prep, triage, windows
from flowsieve.session import scratch_folder, written
from flowsieve.sources.flows import FEATURES, event_records, event_scores, order_flows

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return sum("Exchange hashpartitioning" in line for line in plan(df).splitlines())


def test_scans_read_only_the_needed_columns(spark):
    text = plan(order_flows(spark, FOLDER).select("flow_id", "fwd_bytes"))
    assert "l_extendedprice" in text
    assert "l_tax" not in text and "o_totalprice" not in text and "l_partkey" not in text


def test_order_flows_shuffles_each_table_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffles(order_flows(spark, FOLDER)) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_fitted_preparation_is_one_projection(spark):
    flows = order_flows(spark, FOLDER)
    fitted = prep.fit_prep(flows, FEATURES)
    stored = written(flows, "test-flows")
    text = plan(fitted.transform(stored, ["flow_id"]))
    assert "Exchange" not in text and "Join" not in text


def test_flag_is_a_pushed_filter(spark):
    scores = written(event_scores(spark, FOLDER), "test-scores")
    flagged = scores.filter(iforest.flag_lowest(scores, "score", 0.1))
    text = plan(flagged)
    assert "LessThan(score," in text and "Exchange" not in text


def test_top_rows_need_no_sort(spark):
    scores = written(event_scores(spark, FOLDER), "test-scores")
    text = plan(scores.filter(ordering.top_rows(scores, "score", "id", 100)))
    assert "Exchange" not in text and "Sort" not in text and "Window" not in text


def test_applying_a_quota_is_narrow(spark):
    rows = written(event_scores(spark, FOLDER), "test-scores")
    text = plan(ordering.hash_quota(rows, ["id"], F.lit(100), by=["y"]))
    assert not any(step in text for step in ("Exchange hashpartitioning", "SortMergeJoin", "Union", "Window"))


def test_scoring_is_narrow(spark):
    rows = written(event_scores(spark, FOLDER), "test-scores")
    forest = iforest.fit_forest(rows, ["score"], ["id"], trees=5)
    text = plan(forest.score(rows, ["id"]))
    assert "ArrowEvalPython" in text and "Exchange" not in text


def test_windowed_features_combine_before_each_shuffle(spark):
    text = plan(windows.window_features(event_records(spark, FOLDER)))
    assert text.count("partial_sum") >= 2 and "Expand" not in text


@pytest.mark.parametrize("name", ["ranked", "dedup"])
def test_no_cartesian_products(spark, name):
    if name == "ranked":
        df = curves.roc_curve(curves.ranked_counts(event_scores(spark, FOLDER)))
    else:
        flows = order_flows(spark, FOLDER).withColumn("flag", F.col("true_label")).withColumn(
            "if_score", -F.col("fwd_bytes")
        )
        found = triage.classify_flagged(flows, triage.baseline_stats(flows))
        df = triage.best_per_bucket(found, ["flow_id"])
    assert "CartesianProduct" not in plan(df)


def test_scratch_folder_follows_the_session(spark):
    folder = scratch_folder(spark)
    assert folder.endswith(f"flowsieve/{spark.sparkContext.applicationId}")
    assert scratch_folder(spark) == folder
