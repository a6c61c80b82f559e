import pytest
from pyspark.sql import functions as F

from flowsieve.operators import report, routing, stage2
from flowsieve.operators.routing import QUEUE

ROWS = [
    # id, y, category, flag, predicted, confidence
    (1, 0, "Normal", 0, None, None),
    (2, 1, "DoS", 0, None, None),
    (3, 1, "DoS", 1, "DoS", 0.60),
    (4, 1, "DoS", 1, "Normal", 0.90),
    (5, 0, "Normal", 1, "Normal", 0.80),
    (6, 0, "Normal", 1, "DoS", 0.59),
    (7, 1, "Worms", 1, "DoS", 0.30),
    (8, 1, "Worms", 1, "Worms", 0.95),
    (9, 1, "Worms", 1, None, None),
]


@pytest.fixture(scope="module")
def routed(spark):
    df = spark.createDataFrame(
        ROWS, "id int, y int, category string, flag int, predicted string, confidence double"
    )
    return routing.route(df, 0.60)


def test_routes(routed):
    found = {r.id: (r.route, r.final) for r in routed.collect()}
    assert found == {
        1: ("NORMAL", 0), 2: ("NORMAL", 0), 3: ("DoS", 1), 4: ("Normal", 0), 5: ("Normal", 0),
        6: (QUEUE, 1), 7: (QUEUE, 1), 8: ("Worms", 1), 9: (QUEUE, 1),
    }


def test_queue(routed):
    quality = routing.queue_quality(routed, ["Worms"]).first()
    assert (quality.queued, quality.attacks, quality.false_alarms, quality.hidden) == (3, 2, 1, 2)
    assert quality.precision == pytest.approx(2 / 3)
    composition = [tuple(r) for r in routing.queue_composition(routed, ["Worms"]).collect()]
    assert [(c, n, h) for c, n, _, h in composition] == [("Worms", 2, 1), ("Normal", 1, 0)]
    empty = routing.queue_quality(routed.filter("id < 3"), ["Worms"]).first()
    assert (empty.queued, empty.precision, empty.hidden_share) == (0, 0.0, 0.0)


def test_by_class_and_hidden(routed):
    by_class = {r.category: tuple(r)[1:] for r in routing.routing_by_class(routed, ["Worms"]).collect()}
    assert by_class == {
        "DoS": (2, 1, 0, 1, 50.0, 0.0),
        "Worms": (3, 0, 2, 1, 0.0, pytest.approx(200 / 3)),
    }
    seen = {r.category: tuple(r)[1:] for r in routing.routing_by_class(routed).collect()}
    assert seen["Worms"][:4] == (3, 1, 2, 0)
    hidden = {r.category: r for r in routing.hidden_detection(routed, ["Worms", "Shellcode"]).collect()}
    assert (hidden["Worms"].total, hidden["Worms"].flagged, hidden["Worms"].queued) == (3, 3, 2)
    assert (hidden["Shellcode"].total, hidden["Shellcode"].queued_pct) == (0, 0.0)


def test_false_alarms_and_summary(routed):
    found = routing.false_alarm_reduction(routed).first()
    assert (found.stage1_fp, found.final_fp, found.reduction) == (2, 1, 0.5)
    summary = report.two_stage_summary("x", routed).first()
    assert summary.stage1_f1 == pytest.approx(2 * 5 / (2 * 5 + 2 + 1))
    assert summary.final_f1 == pytest.approx(2 * 4 / (2 * 4 + 1 + 2))
    assert summary.queue_precision == pytest.approx(2 / 3)


def test_class_hold_out(routed):
    kept = routing.hold_out(routed, "category", ["Worms"], "flag")
    assert sorted(r.id for r in kept.collect()) == [3, 4, 5, 6]


def striped(spark, names):
    """300 rows whose class can be read off one feature."""
    n = len(names)
    df = spark.range(300).select(
        "id",
        (F.col("id") % n + F.rand(1) * 0.2).alias("x 1"),
        F.rand(2).alias("x2"),
        F.get(F.array(*[F.lit(c) for c in names]), (F.col("id") % n).cast("int")).alias("k"),
    )
    return spark.createDataFrame(df.toPandas())


@pytest.mark.parametrize("names", [["a", "b"], ["a", "b", "c"]])
@pytest.mark.parametrize("kind", ["boosting", "forest"])
def test_stage2_learns_and_gives_probabilities(spark, names, kind):
    n, df = len(names), striped(spark, names)
    model = stage2.fit_stage2(df, ["x 1", "x2"], "k", rounds=10, depth=3, kind=kind)
    assert model.classes == tuple(names)
    found = model.predict(df.drop("k").join(df.select("id", F.col("k").alias("truth")), "id"))
    assert found.filter("predicted = truth").count() >= 285
    assert found.filter(F.size("probabilities") == n).count() == 300
    assert found.filter("confidence < 1.0 / 3 or confidence > 1").count() == 0
    total = F.aggregate("probabilities", F.lit(0.0), lambda x, y: x + y)
    assert found.filter(F.abs(total - 1) > 1e-9).count() == 0


def test_stage2_of_one_class_is_certain(spark):
    df = striped(spark, ["only"])
    found = stage2.fit_stage2(df, ["x2"], "k", rounds=2).predict(df.drop("k")).first()
    assert (found.predicted, found.confidence, list(found.probabilities)) == ("only", 1.0, [1.0])


def test_stage2_needs_rows_and_known_kinds(spark):
    df = striped(spark, ["a", "b"])
    with pytest.raises(ValueError, match="no labelled rows"):
        stage2.fit_stage2(df.filter("id < 0"), ["x2"], "k")
    with pytest.raises(ValueError, match="kind"):
        stage2.fit_stage2(df, ["x2"], "k", kind="linear")
