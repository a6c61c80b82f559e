import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.functions.columns import finite_or_null, number_or_zero, z_score
from flowsieve.operators import prep
from flowsieve.sources import flows, tables


def test_numbers_from_text(spark):
    df = spark.createDataFrame([("1.5",), ("n/a",), (None,), ("NaN",), ("Infinity",)], "s string")
    found = [r[0] for r in df.select(number_or_zero("s")).collect()]
    assert found == [1.5, 0.0, 0.0, 0.0, math.inf]


def test_not_finite_is_null(spark):
    values = [1.0, math.nan, math.inf, -math.inf, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(finite_or_null("v")).collect()] == [1.0, None, None, None, None]


def test_z_score_floor_and_null(spark):
    df = spark.createDataFrame([(3.0,)], "v double")
    floor, missing = df.select(
        z_score("v", 1.0, 0.0), z_score("v", 1.0, F.lit(None).cast("double"))
    ).first()
    assert floor == pytest.approx(2e9) and missing is None


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = [
        (i, float(v), -float(v) ** 2, 7.0, None if i % 9 == 0 else (math.inf if i % 10 == 0 else float(i)))
        for i, v in enumerate(rng.lognormal(0, 1.2, 500))
    ]
    return spark.createDataFrame(rows, "id bigint, right double, left double, same double, dirty double")


COLUMNS = ["right", "left", "same", "dirty"]


def test_fit_follows_the_usual_definitions(table):
    pdf = table.toPandas().replace([np.inf, -np.inf], np.nan)
    x = pdf[COLUMNS].fillna(pdf[COLUMNS].median())
    one, two = prep.fit_prep(table, COLUMNS, two_sided=False), prep.fit_prep(table, COLUMNS)
    assert one.medians == pytest.approx(pdf[COLUMNS].median().to_dict())
    assert one.kept == ("right", "left", "dirty")
    for c in one.kept:
        assert one.skews[c] == pytest.approx(x[c].skew())
    assert one.skewed == ("right",) and two.skewed == ("right", "left")
    shaped = x[list(two.kept)].copy()
    shaped[list(two.skewed)] = np.log1p(shaped[list(two.skewed)].clip(lower=0))
    # The logged left column is constant: its deviation is 0 and it is only centred.
    deviation = shaped.std(ddof=0).replace(0, 1)
    expected = ((shaped - shaped.mean()) / deviation).to_numpy()
    found = two.transform(table, ["id"]).orderBy("id").toPandas()[list(two.kept)].to_numpy()
    assert np.allclose(found, expected)


def test_test_rows_use_trained_numbers_unless_told_otherwise(table):
    train, test = table.filter("id < 300"), table.filter("id >= 300")
    fitted = prep.fit_prep(train, ["dirty"])
    own = prep.fit_medians(test, ["dirty"])
    gap = test.filter("id = 306")
    trained, replaced = (
        gap.select(fitted.imputed("dirty", m)).first()[0] for m in (None, own)
    )
    assert trained == fitted.medians["dirty"] and replaced == own["dirty"] and trained != replaced


def test_winsorise_per_class(spark):
    df = spark.createDataFrame(
        [(i, i % 2, float(i)) for i in range(200)], "id bigint, y int, v double"
    )
    found = prep.winsorise(df, ["v"], 0.9, by="y").toPandas()
    pdf = df.toPandas()
    for y, part in pdf.groupby("y"):
        expected = part["v"].clip(upper=part["v"].quantile(0.9))
        assert np.allclose(found[found["y"] == y].sort_values("id")["v"], expected)


def test_spread_over_day(spark):
    times = prep.spread_over_day(spark.range(7), ["id"]).orderBy("timestamp").toPandas()["timestamp"]
    step = round(86_400_000_000 / 7)
    assert [(t - times[0]).value // 1000 for t in times] == [i * step for i in range(7)]
    assert str(times[0]) == "2024-01-15 00:00:00"


def test_label_resolution(spark):
    ok = spark.createDataFrame([(1,), (0,)], "Label int")
    assert tables.resolve_label(ok).columns == ["Label", "true_label"]
    for bad in (spark.createDataFrame([(2,)], "Label int"), spark.createDataFrame([(None,)], "Label int"),
                spark.createDataFrame([(1,)], "other int")):
        with pytest.raises(ValueError):
            tables.resolve_label(bad)


def test_missing_csv_is_an_error(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.scan_csv(spark, "/tmp/no-such-flow-file.csv", flows.flow_file_schema())


def test_column_choice(spark):
    df = spark.createDataFrame([(1, "a", 2.0, True)], "a int, b string, c double, d boolean")
    assert tables.numeric_columns(df, ["a"]) == ["c"]
    assert tables.feature_columns(df, ["b", "zzz"]) == ["a", "c", "d"]


def test_label_codes_are_alphabetical(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "k string")
    found = {r.k: r.class_id for r in prep.encode_labels(df, "k").collect()}
    assert found == {"a": 0, "b": 1, "c": 2, None: None}


@pytest.mark.parametrize("limit", ["7", "1000000"])
def test_encode_texts_without_one_task(spark, limit):
    names = sorted({f"name {i * 37 % 101}" for i in range(90)} | {"É", "", "zz"}, key=lambda w: w.encode())
    rows = [(i, names[i % len(names)]) for i in range(300)] + [(300, None)]
    df = spark.createDataFrame(rows, "id long, `a class` string").repartition(3)
    spark.conf.set("flowsieve.taskRows", limit)
    try:
        codes = prep.label_codes(df, "a class", "n")
        text = codes._jdf.queryExecution().executedPlan().toString()
        found = prep.encode_labels(df, "a class", "n").collect()
    finally:
        spark.conf.unset("flowsieve.taskRows")
    assert {r.id: r.n for r in found} == {i: None if w is None else names.index(w) for i, w in rows}
    # Only the ranges' totals, which are broadcast, are summed up in one task.
    assert limit != "7" or "SinglePartition" not in text.split("BroadcastExchange")[0]


def test_many_codes_are_joined_by_sorting(spark):
    """Their compressed file is small enough to be broadcast, what it holds need not be."""
    rows = spark.range(30_000).select(F.format_string("name-%06d", "id").alias("name"))
    encoded = prep.encode_labels(rows, "name")
    text = encoded._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text
    assert encoded.agg(F.sum("class_id")).first()[0] == sum(range(30_000))
