"""Queries that fit, store the fit, load it again and only then use it."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.catalog import detect, prepare, respond
from flowsieve.catalog.views import r, rounded, sql
from flowsieve.operators import prep
from flowsieve.operators.windows import window_features
from flowsieve.plans.detect import WINDOW_FEATURES, fit_forest_detector
from flowsieve.plans.stored import load_fit, store_fit
from flowsieve.session import scratch_path, written
from flowsieve.sources.flows import FEATURES, event_records, order_flows
from flowsieve.streaming.scores import read_scored, scored_stream
from flowsieve.streaming.windows import stream_window_features

QUERIES = {}
SQL = {}


def reloaded(fit, spark, columns):
    folder = scratch_path(spark, "stored-fit")
    store_fit(fit, spark, folder)
    return load_fit(spark, folder, columns)


def stored_prep(spark, folder):
    """Fitted on the training part, stored, loaded, applied to the other part."""
    split = written(prepare.split_flows(order_flows(spark, folder)), "split")
    fitted = prep.fit_prep(split.filter("is_test = 0"), prepare.APPLIED)
    loaded = reloaded(fitted, spark, prepare.APPLIED)
    return rounded(loaded.transform(split.filter("is_test = 1"), ["flow_id"]))


def stored_forest(spark, folder):
    """Scores of a forest that was stored and loaded."""
    matrix = detect.flow_matrix(spark, folder)
    scored = reloaded(detect.flow_forest(matrix), spark, FEATURES).score(matrix, ["flow_id"])
    return rounded(
        scored.select("flow_id", "mean_path", F.round(-F.col("anomaly_score"), 6).alias("if_score")), 9
    )


QUERIES["c11_stored_fit"] = stored_prep
SQL["c11_stored_fit"] = prepare.SQL["c11_apply_fit"]
QUERIES["d2_stored_forest"] = stored_forest
SQL["d2_stored_forest"] = detect.SQL["d2_forest_scores"]


def keyed_windows(records, window):
    """Features per window and source, with one id for both, written."""
    features = window_features(records, window)
    moment = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")
    return written(features.withColumn("window_id", F.concat_ws("@", "src", moment)), "windows")


def stream_forest(spark, folder):
    """A forest fitted on all hourly windows, stored, and applied to the same events as a stream.

    The last windows stay open, as no later event closes them; those of the last three hours are left out.
    """
    records = event_records(spark, folder)
    path = scratch_path(spark, "records")
    records.write.parquet(path)
    fit_folder = scratch_path(spark, "stored-fit")
    store_fit(fit_forest_detector(keyed_windows(records, "1 hour"), WINDOW_FEATURES, "window_id", 0.02), spark, fit_folder)
    stream = spark.readStream.schema(records.schema).parquet(path)
    out = scratch_path(spark, "scored-windows")
    features = stream_window_features(stream, "1 hour", "10 minutes")
    scored_stream(features, fit_folder, out, scratch_path(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    last = records.agg((F.max("ts") - F.expr("INTERVAL 3 HOURS")).alias("last"))
    found = read_scored(spark, out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    found = found.join(F.broadcast(last), F.col("window_start") < F.col("last"))
    return rounded(found.select("window_start", "src", "n_bytes", "n_packets", "if_score", "flag"))


QUERIES["d2_stream_forest"] = stream_forest
SQL["d2_stream_forest"] = sql(respond.window_flags("1 hour", respond.FOREST_SCORES), body=f"""
    SELECT window_start, src, {r("n_bytes")}, n_packets, {r("if_score")}, flag FROM flagged
    WHERE window_start < (SELECT max(ts) FROM events) - INTERVAL 3 HOURS""")
