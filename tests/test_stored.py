"""Fits that are stored and loaded again give the same results, in another application too."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flowsieve.operators import iforest, prep, recon, stage2
from flowsieve.plans import detect
from flowsieve.plans.stored import load_fit, store_fit
from flowsieve.session import scratch_path, written

ROOT = Path(__file__).resolve().parents[1]
COLUMNS = ["a", "b 1", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(400).select(
        "id",
        (F.rand(1) * 10).alias("a"),
        F.exp(F.randn(2) * 2).alias("b 1"),
        (F.col("id") % 7).cast("double").alias("c"),
        (F.col("id") % 4 == 0).cast("int").alias("y"),
        F.concat(F.lit("k"), F.col("id") % 3).alias("kind"),
    )
    return written(df, "stored-rows")


def again(spark, fit, columns=COLUMNS):
    folder = scratch_path(spark, "stored")
    store_fit(fit, spark, folder)
    return load_fit(spark, folder, columns)


def test_prep(spark, rows):
    fitted = prep.fit_prep(rows.withColumn("a", F.lit(1.0)), COLUMNS)
    assert again(spark, fitted) == fitted and fitted.kept == ("b 1", "c")


def test_forest(spark, rows):
    forest = iforest.fit_forest(rows, COLUMNS, ["id"], trees=7)
    loaded = again(spark, forest)
    assert (loaded.features, loaded.trees, loaded.sample_rows) == (forest.features, 7, forest.sample_rows)
    assert loaded.score(rows).orderBy("id").collect() == forest.score(rows).orderBy("id").collect()


def test_reconstruction(spark, rows):
    fitted = recon.fit_reconstruction(rows, COLUMNS, 2)
    assert again(spark, fitted).score(rows).orderBy("id").collect() == fitted.score(rows).orderBy("id").collect()


@pytest.mark.parametrize("label, kind", [("y", "boosting"), ("kind", "boosting"), ("kind", "forest")])
def test_second_stage(spark, rows, label, kind):
    fitted = stage2.fit_stage2(rows, COLUMNS, label, rounds=2, depth=2, kind=kind)
    loaded = again(spark, fitted)
    assert loaded.classes == fitted.classes and len(loaded.models) == len(fitted.models)
    assert loaded.predict(rows).orderBy("id").collect() == fitted.predict(rows).orderBy("id").collect()


def test_other_columns_are_refused(spark, rows):
    fitted = prep.fit_prep(rows, COLUMNS)
    with pytest.raises(ValueError, match="missing \\['c'\\], not fitted \\['d'\\]"):
        again(spark, fitted, ["a", "b 1", "d"])
    with pytest.raises(ValueError, match="another order"):
        again(spark, fitted, ["c", "b 1", "a"])
    with pytest.raises(TypeError):
        store_fit("no fit", spark, scratch_path(spark, "stored"))


OTHER = """
import json, sys
from pyspark.sql import SparkSession
from flowsieve.plans.stored import load_fit
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
model = load_fit(spark, sys.argv[1], ["a", "b 1", "c"])
found = model.run(spark.read.parquet(sys.argv[2]), ["id", "y", "kind"], 0.4)
print("FOUND " + json.dumps([[r.id, r.route, r.final, r.recon_error] for r in found.orderBy("id").collect()]))
"""


def test_two_stages_in_another_application(spark, rows, tmp_path):
    model = detect.fit_two_stage(rows, COLUMNS, "y", "kind", rounds=2, depth=2)
    store_fit(model, spark, str(tmp_path / "fit"))
    rows.write.parquet(str(tmp_path / "rows"))
    expected = model.run(rows, ["id", "y", "kind"], 0.4).orderBy("id").collect()
    done = subprocess.run(
        [sys.executable, "-c", OTHER, str(tmp_path / "fit"), str(tmp_path / "rows")],
        capture_output=True, text=True, cwd=ROOT, timeout=300,
    )
    line = next(x for x in done.stdout.splitlines() if x.startswith("FOUND "))
    assert json.loads(line[6:]) == [[r.id, r.route, r.final, r.recon_error] for r in expected]


def test_curved_reconstruction(spark, rows):
    fitted = recon.fit_curved_reconstruction(rows, COLUMNS)
    assert again(spark, fitted).score(rows).orderBy("id").collect() == fitted.score(rows).orderBy("id").collect()
