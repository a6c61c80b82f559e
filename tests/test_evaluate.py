from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import curves, distributions, ensemble, report
from flowsieve.sources.flows import event_records, event_scores
from flowsieve.operators.windows import window_features
from flowsieve.streaming.windows import stream_window_features

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scores(spark):
    return event_scores(spark, FOLDER)


@pytest.fixture(scope="module")
def ranked(scores):
    return curves.ranked_counts(scores)


def test_bucketed_counts_are_the_same(scores, ranked):
    columns = ["threshold", "pos", "neg", "tp", "fp", "positives", "negatives"]
    bucketed = curves.ranked_counts(scores, task_rows=10)
    plain = ranked.select(columns).orderBy("threshold").collect()
    assert bucketed.select(columns).orderBy("threshold").collect() == plain


def test_curve_identities(scores, ranked):
    roc = curves.roc_curve(ranked).toPandas().sort_values(["fpr", "tpr"])
    assert (roc["fpr"].iloc[0], roc["tpr"].iloc[0]) == (0, 0)
    assert (roc["fpr"].iloc[-1], roc["tpr"].iloc[-1]) == (1, 1)
    assert curves.ks_distance(ranked).first().ks == pytest.approx((roc["tpr"] - roc["fpr"]).abs().max())
    area = np.trapezoid(roc["tpr"], roc["fpr"])
    assert curves.roc_auc(ranked).first().auc == pytest.approx(area)
    pdf = scores.toPandas()
    wins = pdf[pdf["y"] == 1]["score"].to_numpy()[:, None] - pdf[pdf["y"] == 0]["score"].to_numpy()
    assert area == pytest.approx(((wins > 0) + 0.5 * (wins == 0)).mean())


def test_counts_add_up(scores):
    flagged = scores.withColumn("flag", (F.col("score") > 60).cast("int"))
    m = report.metrics(flagged).first()
    assert m.tn + m.fp + m.fn + m.tp == scores.count()
    assert report.tidy_metrics(report.metrics(flagged)).count() == 4
    nothing = report.metrics(scores.withColumn("flag", F.lit(0))).first()
    assert (nothing.precision, nothing.recall, nothing.f1) == (0.0, 0.0, 0.0)


def test_one_class_only(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0)], "y int, score double")
    ranked = curves.ranked_counts(df)
    assert curves.roc_auc(ranked).first().auc == 0.0
    assert curves.average_precision(ranked).first().average_precision == 0.0


def test_last_histogram_bin_is_closed(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 5.0), (1, 10.0), (1, 10.0)], "y int, v double")
    found = {(r["class"], r["bin"]): r.n for r in distributions.histogram(df, "v", "y", 5).collect()}
    assert found == {(0, 0): 1, (0, 2): 1, (1, 4): 2}


def test_unknown_effect_column_is_an_error(scores):
    with pytest.raises(ValueError):
        distributions.cohens_d(scores, ["nope"], "y")


def test_sweep_flags_at_least_the_share(scores):
    n = scores.count()
    sweep = distributions.threshold_sweep(scores.select("y", (-F.col("score")).alias("if_score")))
    rows = sweep.orderBy("step").collect()
    assert len(rows) == 15
    assert all(r.tp + r.fp >= int(n * r.share) + 1 for r in rows)
    with_ties = distributions.best_of_sweep(sweep).first()
    assert with_ties.f1 == max(r.f1 for r in rows)


def test_stream_gives_the_batch_features(spark, tmp_path):
    records = event_records(spark, FOLDER)
    late = records.agg(F.max("ts")).first()[0]
    source = str(tmp_path / "in")
    records.write.parquet(source)
    stream = spark.readStream.schema(records.schema).parquet(source)
    query = (
        stream_window_features(stream, "1 hour", "10 minutes")
        .writeStream.outputMode("append").format("memory").queryName("window_features")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    found = spark.table("window_features").withColumn(
        "window_start", F.col("window_start").cast("timestamp_ntz")
    )
    limit = F.lit(late) - F.expr("INTERVAL 3 HOURS")
    closed = window_features(records, "1 hour").filter(F.col("window_start") < limit)
    done = found.filter(F.col("window_start") < limit)
    key = ["window_start", "src"]
    columns = [*key, "n_bytes", "n_packets", "n_dst_ports", "failed_ratio"]
    expected = closed.select(columns).orderBy(*key).toPandas()
    actual = done.select(columns).orderBy(*key).toPandas()
    assert len(actual) == len(expected) > 0
    assert np.allclose(actual.iloc[:, 2:].astype(float), expected.iloc[:, 2:].astype(float))


def test_constant_scores(spark):
    df = spark.createDataFrame([(i % 2, 3.0) for i in range(10)], "y int, score double")
    grid = distributions.cdf_grid(df, points=5).orderBy("point").collect()
    assert [(r.cdf_positive, r.cdf_negative) for r in grid] == [(1.0, 1.0)] * 5
    bins = distributions.histogram(df, "score", "y", 4).collect()
    assert sorted((r["class"], r.bin, r.bin_start, r.n) for r in bins) == [(0, 2, 3.0, 5), (1, 2, 3.0, 5)]
    assert {r.density for r in distributions.kernel_density(df, points=3).collect()} == {None}
    empty = df.limit(0)
    assert distributions.histogram(empty, "score", "y", 4).count() == 0
    assert distributions.cdf_grid(empty, points=5).count() == 5


@pytest.mark.parametrize("flags", [["a"], ["a", "b"], ["a", "b", "c", "d"]])
def test_overlap_of_any_number_of_detectors(spark, flags):
    rows = [(i % 3 % 2, *[int((i >> k) % 3 == 0) for k in range(4)]) for i in range(200)] + [(1, None, 1, None, 0), (None, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "y int, a int, b int, c int, d int")
    found = {r.region: r.caught for r in ensemble.detector_overlap(df, flags).collect()}
    expected = Counter()
    for y, *hits in rows:
        caught = [f for f, h in zip("abcd", hits) if f in flags and h == 1] if y == 1 else []
        if caught:
            name = "all" if caught == flags else f"only {caught[0]}" if len(caught) == 1 else "+".join(caught)
            expected[name] += 1
            expected["any"] += 1
    assert len(found) == 2 ** len(flags)
    assert {name: n for name, n in found.items() if n} == dict(expected)


def direct_density(values, points):
    lo, hi, h = values.min(), values.max(), values.std(ddof=1) * 0.15
    at = lo + np.arange(points) * (hi - lo) / (points - 1)
    return np.exp(-0.5 * ((at[:, None] - values) / h) ** 2).mean(1) / (h * np.sqrt(2 * np.pi)), h


@pytest.mark.parametrize("shape", ["normal", "long tail", "two lumps"])
def test_density_error_is_bounded(spark, shape):
    rng = np.random.default_rng(3)
    values = {
        "normal": rng.normal(size=2000),
        "long tail": rng.pareto(1.1, 2000),
        "two lumps": np.concatenate([rng.normal(0, 1e-3, 500), rng.normal(1e6, 10, 500)]),
    }[shape]
    df = spark.createDataFrame([(1, float(v)) for v in values] + [(1, None), (None, 2.0), (None, 5.0)], "y int, score double")
    found = [r for r in distributions.kernel_density(df, points=60).collect() if r["class"] == 1]
    expected, h = direct_density(values, 60)
    height = 1 / (h * np.sqrt(2 * np.pi))
    assert np.abs(np.array([r.density for r in sorted(found, key=lambda r: r.point)]) - expected).max() < 1e-9 * height


def test_density_costs_by_boxes_not_by_scores(spark):
    df = spark.range(40_000).select(F.lit("k").alias("g"), F.rand(5).alias("z"))
    boxes = distributions.box_moments(df, F.col("z") * 10, ["g"])
    assert boxes.count() <= 10 / distributions.GAUSS_BOX + 1
