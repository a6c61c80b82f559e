"""Whole runs: from a flow file to findings, two stages, detectors side by side."""

import time
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import prep, routing
from flowsieve.plans import detect
from flowsieve.session import SHUFFLE_CLEANUP, drop_written, scratch_folder, written, written_lean
from flowsieve.sources import flows, tables

FOLDER = "/root/testdata/sf0.001"


def test_from_file_to_findings(spark, tmp_path):
    path = str(tmp_path / "flows")
    source = flows.order_flows(spark, FOLDER)
    flows.flow_file_rows(source).write.option("header", True).csv(path)
    raw = tables.resolve_label(tables.scan_csv(spark, path, flows.flow_file_schema()))
    rows = prep.featurise(raw, keep=["flow_id", "true_label"])
    rows = written(prep.spread_over_day(rows, ["flow_id"], name="ts"), "rows")
    n = source.count()
    assert rows.count() == n
    flagged = detect.flag_scored(detect.forest_scores(rows, flows.FEATURES, "flow_id"), 0.40)
    assert flagged.count() == n
    assert 0.3 * n < flagged.filter("flag = 1").count() <= 0.40 * n
    report = detect.ranked_findings(flagged, "flow_id").orderBy("rank").collect()
    assert [r["rank"] for r in report] == list(range(1, len(report) + 1))
    assert len({(r.type, r.bucket) for r in report}) == len(report)
    assert all(r.mitigations for r in report)


def test_forest_scores_do_not_depend_on_partitioning(spark):
    base = written(flows.order_flows(spark, FOLDER), "base")
    results = []
    for parts in (1, 8):
        scored = detect.forest_scores(base.repartition(parts), flows.FEATURES, "flow_id", trees=30)
        rows = scored.select("flow_id", F.round("if_score", 9)).orderBy("flow_id").collect()
        results.append(rows)
    assert results[0] == results[1]


@pytest.fixture(scope="module")
def labelled(spark):
    """Four classes: the first two features tell them apart, attacks leave the benign line."""
    rows = spark.range(2000).select(
        "id",
        F.get(F.array(*[F.lit(c) for c in ("Normal", "Normal", "DoS", "Worms", "Fuzzers")]),
              (F.col("id") % 5).cast("int")).alias("attack_cat"),
        F.randn(1).alias("a"),
        F.randn(2).alias("noise"),
    )
    shift = F.when(F.col("attack_cat") == "DoS", 6).when(F.col("attack_cat") == "Worms", -6).when(
        F.col("attack_cat") == "Fuzzers", 12).otherwise(0)
    rows = rows.select(
        "id", "attack_cat", (F.col("attack_cat") != "Normal").cast("int").alias("y"), "a",
        (F.col("a") + 0.1 * F.col("noise") + shift).alias("b"),
        (F.col("a") * 2 + F.col("noise") * 0.1).alias("c"), F.col("noise").alias("d"),
    )
    rows = spark.createDataFrame(rows.toPandas())
    return rows.filter("id % 100 < 70"), rows.filter("id % 100 >= 70")


def test_hidden_class_is_never_predicted(labelled):
    train, test = labelled
    model = detect.fit_two_stage(
        train, ["a", "b", "c", "d"], "y", "attack_cat", hidden=["Worms"], rounds=20, depth=4
    )
    assert "Worms" not in model.classifier.classes
    routed = model.run(test, ["id", "y", "attack_cat"], routing.HOLD_OUT_CONFIDENCE)
    assert routed.count() == test.count()
    assert routed.filter("route = 'Worms'").count() == 0
    passed = routed.filter("flag = 0")
    assert passed.filter("final = 1").count() == 0
    rates = {r.y: r.rate for r in routed.groupBy("y").agg(F.avg("flag").alias("rate")).collect()}
    # About one benign training row in twenty lies above the cut.
    assert rates[0] < 0.15 and rates[1] > 3 * rates[0]


def test_detectors_side_by_side(labelled):
    train, _ = labelled
    scored = detect.detector_scores(train, ["a", "b", "c", "d"], "id", "y")
    assert scored.count() == train.count()
    assert scored.columns == ["id", "y", "if_score", "recon_score", "lof_score", "ensemble"]
    assert scored.filter("ensemble < 0 or ensemble > 1").count() == 0


def test_detectors_leave_only_their_scores_in_scratch(spark):
    """The matrix and what the neighbour search wrote stayed until the application ended; input files are not touched."""
    rng = np.random.default_rng(6)
    rows = [(i, int(i % 7 == 0), *map(float, p)) for i, p in enumerate(rng.normal(size=(300, 3)).round(1))]
    rows += [(300 + i, *rows[i][1:]) for i in range(20)]
    df = spark.createDataFrame(rows, "id bigint, y int, a double, b double, c double")
    stored = written(df, "test-input")
    top = Path(urlparse(scratch_folder(spark)).path)
    before = set(top.iterdir())
    scored = detect.detector_scores(stored, ["a", "b", "c"], "id", "y", neighbours=5)
    left = {p.name.rsplit("-", 1)[0] for p in set(top.iterdir()) - before}
    assert "detectors" in left and not [name for name in left if name == "matrix" or name in ("lof-cells", "lof-groups", "lof-factors")]
    assert scored.count() == 320 and stored.count() == 320


def test_drop_written_spares_files_outside_scratch(spark, tmp_path):
    path = f"file://{tmp_path}/input"
    spark.range(5).write.parquet(path)
    source = spark.read.parquet(path)
    copy = written(source, "test-copy")
    drop_written(source.unionByName(copy))
    assert spark.read.parquet(path).count() == 5
    folder = Path(urlparse(copy.inputFiles()[0]).path).parent
    assert not folder.exists()


def test_a_lean_table_keeps_no_shuffle_files(spark):
    spark.conf.unset(SHUFFLE_CLEANUP)
    default = spark.conf.get(SHUFFLE_CLEANUP, None)
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def kept():
        found = files.getAllFiles().toList()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle")}

    before = kept()
    grouped = spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).count()
    lean = written_lean(grouped, "test-lean")
    for _ in range(50):
        if not kept() - before:
            break
        time.sleep(0.2)
    assert not kept() - before and lean.count() == 5000
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == default
