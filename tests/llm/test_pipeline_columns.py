"""Columns of documents that have the names of columns the operators add come back as they were."""

import pytest
from pyspark.sql import functions as F
from test_pipeline import folder, rows  # noqa: F401

import corpus_pipeline

NAMES = "text_key n_words hits n_hit items contaminated places words spans owners score kept count label block row weight".split()
STAGES = [(name, stage) for name, stage in corpus_pipeline.STAGES if name != "packing"]


@pytest.mark.parametrize("name,stage", STAGES)
def test_clashing_columns_are_kept(spark, folder, name, stage):  # noqa: F811
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = docs.select(*[F.concat_ws("-", F.lit(n), "doc_id", "source").alias(n) for n in NAMES], "*")
    extra = extra.select(*NAMES, *docs.columns[::-1])
    found = stage(spark, extra, folder)
    assert found.columns == extra.columns
    kept = found.collect()
    assert all(r[n] == "-".join(str(x) for x in (n, r.doc_id, r.source) if x is not None) for r in kept for n in NAMES)
    assert rows(found.select(*docs.columns)) == rows(stage(spark, docs, folder))
    assert kept and rows(found) != rows(extra)
