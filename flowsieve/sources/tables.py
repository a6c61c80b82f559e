"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.functions.columns import quoted


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header. A missing path is an error. Give a schema to avoid an inference pass."""
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).option("enforceSchema", False).csv(path)


def union_classes(
    sources: Sequence[tuple[DataFrame, int]], label: str = "true_label"
) -> DataFrame:
    """Tag each source with its class and append them."""
    tagged = [df.withColumn(label, F.lit(value).cast("int")) for df, value in sources]
    union = tagged[0]
    for other in tagged[1:]:
        union = union.unionByName(other)
    return union


def resolve_label(df: DataFrame, label: str = "true_label", fallback: str = "Label") -> DataFrame:
    """Make sure a 0/1 ``label`` column exists; a ``fallback`` column must hold only 0 and 1."""
    if label in df.columns:
        return df
    if fallback in df.columns:
        column = F.col(quoted(fallback))
        binary = df.agg(F.bool_and(F.coalesce(column.isin(0, 1), F.lit(False)))).first()[0]
        if binary:
            return df.withColumn(label, column.cast("int"))
    raise ValueError(f"no {label} column, and no {fallback} column with only 0 and 1")


def feature_columns(df: DataFrame, drop: Sequence[str]) -> list[str]:
    """Every column but those of the drop list."""
    return [c for c in df.columns if c not in set(drop)]


def numeric_columns(df: DataFrame, drop: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in set(drop)
    ]


def write_findings(df: DataFrame, path: str, form: str = "json") -> None:
    """Write a findings table, one file per partition."""
    df.write.mode("overwrite").format(form).save(path)


def read_findings(
    spark: SparkSession, path: str, schema: T.StructType, form: str = "json"
) -> DataFrame:
    return spark.read.schema(schema).format(form).load(path)
