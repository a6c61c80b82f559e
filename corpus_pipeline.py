"""The corpus pipeline: documents to training batches in stages, each written before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm import decontaminate, neardup, packing, secrets, toxicity
from flowsieve.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _rest(docs: DataFrame) -> Column:
    """All columns but the text as one, ``_rest``, so that no name of theirs meets one a stage adds."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("_rest")


def _unpacked(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of ``docs`` from ``text`` and ``_rest``, but for those that are given."""
    whole = {c: F.col("_rest").getField(c) for c in docs.columns} | {"text": F.col("text")} | changed
    return [whole[c].alias(c) for c in docs.columns]


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; every label is learnt from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels, F.lit(True)))


def near_duplicates_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id, and one of its repeated rows."""
    kept = neardup.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    unique = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
    repeated = docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null")
    if repeated.isEmpty():
        return unique
    text_key = unique.withColumn("_text_key", F.xxhash64("text"))
    named = text_key.filter("doc_id is not null").dropDuplicates(["doc_id", "_text_key"])
    return named.unionByName(text_key.filter("doc_id is null")).drop("_text_key")


def contaminated_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(docs.select("doc_id", "text", _rest(docs)), benchmark)
    return found.filter("not contaminated").select(*_unpacked(docs))


def secrets_are_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced in the text; widely copied examples and all documents stay."""
    found = secrets.find_secrets(docs, F.col("source"), F.concat_ws("/", "source", "lang"))
    live = F.filter("spans", lambda s: s["live"])
    masks = (
        found.select(F.col("doc_id").alias("_doc_id"), "text_key", live.alias("_live"))
        .filter(F.size("_live") > 0)
        .dropDuplicates(["_doc_id", "text_key"])
    )
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.xxhash64("text") == F.col("text_key"))
    hit = F.col("_live").isNotNull()
    text = F.when(hit, secrets.redacted(F.col("text"), F.col("_live"))).otherwise(F.col("text"))
    n_chars = F.when(hit, F.length("_text").cast("bigint")).otherwise(F.col("_rest.n_chars"))
    joined = docs.select("doc_id", "text", _rest(docs)).join(masks, same, "left").withColumn("_text", text)
    return joined.select(*_unpacked(docs, text=F.col("_text"), n_chars=n_chars))


def documents_are_packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic_documents_go),
    ("near_duplicates", near_duplicates_go),
    ("decontamination", contaminated_documents_go),
    ("secrets", secrets_are_masked),
    ("packing", documents_are_packed),
]

# A fitted classifier and signatures are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``. Nulls, empty tables and repeated rows: see the operators."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
