"""The bound on training rows, blocks by rows and bytes, and weights that stand for copies."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowsieve.llm import labelled, quality, toxicity

ROWS = [(i, " ".join(f"w{(7 * i + k * k) % 40}" for k in range(12)) + (" vile." if i % 2 else " nice.")) for i in range(40)]
LABELS = [(i, i % 2, i % 2) for i in range(41)]


def tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_repeated_rows_and_ids_are_bounded(spark):
    rows = ROWS + [ROWS[3]] * 500 + [(40, f"text {i}") for i in range(300)] + [(40, None)] * 20
    docs, labels = tables(spark, rows)
    found = labelled.training_rows(docs, labels, "toxic", F.lit(True), rows=1000).collect()
    assert len(found) == 40 + 301 and sum(r.weight for r in found) == len(rows)
    assert {(r.text, r.weight) for r in found if r.weight > 1} == {(ROWS[3][1], 501), (None, 20)}
    assert sorted(r.row for r in found) == list(range(len(found)))
    assert len(labelled.training_rows(docs, labels, "toxic", F.lit(True), rows=100).collect()) == 100


def test_blocks_hold_few_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(labelled, "BLOCK_ROWS", 10)
    monkeypatch.setattr(labelled, "BLOCK_BYTES", 1000)
    rng = np.random.default_rng(4)
    for sizes in ([], [0] * 95, [5000] + [10] * 40, rng.integers(0, 400, 200).tolist()):
        blocks = labelled.dealt_blocks(sizes)
        assert len(blocks) == len(sizes)
        for b in set(blocks):
            held = [s for s, x in zip(sizes, blocks) if x == b]
            assert len(held) <= 10 and (sum(held) - max(held) <= 1000)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_no_task_reads_all_copies(spark, module, monkeypatch):
    """A repeated row that makes up most of the table is one bag of words."""
    kept = []
    monkeypatch.setattr(module, "written", lambda df, label, write=module.written: kept.append(write(df, label)) or kept[-1])
    docs, labels = tables(spark, ROWS + [ROWS[3]] * 500)
    module.fit(docs, labels, F.lit(True))
    assert kept[0].count() == len(ROWS) and kept[0].agg(F.sum("weight")).first()[0] == len(ROWS) + 500


def test_weights_stand_for_copies(monkeypatch):
    rng = np.random.default_rng(1)
    one = pd.DataFrame({"label": [0, 1, 0, 1], "features": [rng.integers(0, 50, 20) for _ in range(4)]})
    one = one.assign(sizes=[np.array([8, 12])] * 4, weight=[1, 3, 1, 2], row=range(4))
    copies = one.loc[one.index.repeat(one.weight)].assign(weight=1).reset_index(drop=True)
    features, start = np.arange(50), np.zeros(50)
    a, b = (toxicity._descended(x, start, -4.0, features) for x in (one, copies))
    assert np.allclose(a[0], b[0]) and np.isclose(a[1], b[1])
    ratios, zero = rng.normal(size=1 << quality.BITS), np.zeros(1 << quality.BITS)
    monkeypatch.setattr(quality, "COST", 1.0)
    torn = one.assign(label=[0, 1, 1, 1], features=[one.features[0]] * 4, weight=[5, 3, 1, 2])
    _, _, alpha = quality._descended(torn, ratios, zero, 0.0, np.zeros(4))
    assert (alpha <= torn.weight).all() and alpha.max() > 1


def test_quality_fit_does_not_depend_on_how_blocks_are_read(spark):
    """Files of a block read in parts, in other parts each round, keep their dual variables."""
    docs, labels = tables(spark, ROWS)
    setting = "parquet.block.size"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set(setting, "1024")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        model = quality.fit(docs, labels, F.lit(True))
    finally:
        conf.unset(setting)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all((scores[i] > 0.5) == bool(i % 2) for i in range(40))
