"""A stored forest on a stream: the batch result, once each, whatever is repeated or restarted."""

import pytest
from pyspark.sql import functions as F

from flowsieve.catalog.stored import keyed_windows
from flowsieve.plans.detect import WINDOW_FEATURES, fit_forest_detector
from flowsieve.plans.stored import load_fit, store_fit
from flowsieve.session import scratch_path
from flowsieve.sources.flows import event_records
from flowsieve.streaming.scores import read_scored, scored_stream, write_batch
from flowsieve.streaming.windows import stream_window_features

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fitted(spark):
    """(windows, folder of the stored forest) of all events."""
    windows = keyed_windows(event_records(spark, FOLDER), "1 hour")
    folder = scratch_path(spark, "fit")
    store_fit(fit_forest_detector(windows, WINDOW_FEATURES, "window_id", 0.05, trees=20), spark, folder)
    return windows, folder


def test_restarted_stream_gives_the_batch_rows(spark, fitted, tmp_path):
    windows, folder = fitted
    records = event_records(spark, FOLDER)
    middle = records.agg(F.expr("percentile_approx(unix_micros(cast(ts as timestamp)), 0.5)")).first()[0]
    early = F.expr("unix_micros(cast(ts as timestamp))") <= middle
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run():
        stream = spark.readStream.schema(records.schema).parquet(source)
        features = stream_window_features(stream, "1 hour", "10 minutes")
        scored_stream(features, folder, out, state).trigger(availableNow=True).start().awaitTermination(180)

    records.filter(early).coalesce(1).write.parquet(source)
    run()
    first = read_scored(spark, out).count()
    # The stream ends here, and starts anew with what it has kept.
    records.filter(~early).coalesce(1).write.mode("append").parquet(source)
    run()
    found = read_scored(spark, out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    assert 0 < first < found.count()
    last = records.agg((F.max("ts") - F.expr("INTERVAL 3 HOURS"))).first()[0]
    columns = ["window_start", "src", "if_score", "flag"]
    expected = load_fit(spark, folder).run(windows).filter(F.col("window_start") < F.lit(last)).select(columns)
    done = found.filter(F.col("window_start") < F.lit(last)).select(columns)
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, expected.collect()))


def test_a_repeated_batch_leaves_one_copy(spark, fitted, tmp_path):
    windows, folder = fitted
    detector, out = load_fit(spark, folder), str(tmp_path / "out")
    for number, part in ((0, windows.limit(5)), (1, windows.limit(7)), (1, windows.limit(7))):
        write_batch(part, number, detector, out)
    assert read_scored(spark, out).groupBy("batch").count().orderBy("batch").collect() == [(0, 5), (1, 7)]
    write_batch(windows.limit(0), 1, detector, out)
    assert read_scored(spark, out).count() == 5


def test_flags_follow_the_stored_cut(spark, fitted):
    windows, folder = fitted
    found = load_fit(spark, folder).run(windows)
    n = windows.count()
    assert 0.02 * n <= found.filter("flag = 1").count() <= 0.05 * n + 1
