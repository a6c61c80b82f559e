"""Each stage against a plain version on its own input, and the whole run on a small table."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import plain

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with copies, benchmark text, secrets and toxic words, nulls and repeats."""
    rng = random.Random(6)
    place = str(tmp_path_factory.mktemp("corpus"))
    vocabulary = [f"w{i}x" for i in range(500)]
    items = [(i, " ".join(rng.choices(vocabulary, k=20))) for i in range(5)]
    docs, labels = [], []
    for i in range(160):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) + "."
        if i % 4 == 0:
            text += " vile filth trash. vile filth."
        if i % 7 == 0:
            text += " token=" + rng.choice(["sharedexample", f"private{i}value"])
        if i % 9 == 0:
            text += " " + items[i % 5][1]
        docs.append((i, text, "en", f"s{i % 6}", len(text)))
        if i % 2 == 0:
            labels.append((i, 1, int(i % 4 == 0)))
        if i % 5 == 0:
            docs.append((1000 + i, text.upper() if i % 10 else text + " more", "en", "s1", len(text)))
    docs += [(900, None, None, None, None), (901, "", "", "", 0), docs[3], (None, "no id", "de", "s2", 5)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return place


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_stages_follow_each_other(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = rows(spark.read.parquet(f"{folder}/benchmark.parquet"))
    expected = {
        "near_duplicates": plain.near_duplicates_go,
        "decontamination": lambda given: plain.contaminated_go(given, items),
        "secrets": plain.secrets_masked,
    }
    for name, stage in corpus_pipeline.STAGES:
        given = rows(docs)
        found = stage(spark, docs, folder)
        if name != "packing":
            assert found.columns == docs.columns
        kept = rows(found)
        if name in expected:
            assert kept == sorted(expected[name](given), key=repr), name
            assert kept != given, name
        elif name == "toxicity":
            toxic = {r[0] for r in given if "vile" in (r[1] or "").lower()}
            assert {r[0] for r in given} - {r[0] for r in kept} == toxic
        else:
            assert sorted((r[0] for r in kept), key=repr) == sorted((r[0] for r in given), key=repr)
        docs = spark.createDataFrame(kept, found.schema)


def test_run_on_the_smallest_tables(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 100 < found.count() < 200 and {"doc_id", "n_tokens", "bucket", "batch"} <= set(found.columns)


def test_empty_tables(spark, folder, tmp_path):
    place = str(tmp_path)
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{table}.parquet").filter(F.lit(False)).write.parquet(f"{place}/{table}.parquet")
    assert corpus_pipeline.run(spark, place).count() == 0
