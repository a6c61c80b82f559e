"""Combining detectors: normalised scores, their mean, top-k flags, and who caught what."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.columns import quoted, total_of
from flowsieve.operators.ordering import top_rows_of


def normalise(df: DataFrame, scores: Sequence[str], suffix: str = "_norm") -> DataFrame:
    """Min-max scale each score; all ranges come from one aggregation."""
    ends = df.agg(
        *[f(c).alias(f"_{name}_{c}") for c in scores for name, f in (("lo", F.min), ("hi", F.max))]
    )
    return df.join(F.broadcast(ends), F.lit(True)).select(
        *[quoted(c) for c in df.columns],
        *[
            (
                (F.col(c) - F.col(f"_lo_{c}"))
                / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}") + F.lit(1e-9))
            ).alias(f"{c}{suffix}")
            for c in scores
        ],
    )


def mean_score(df: DataFrame, scores: Sequence[str], name: str = "ensemble") -> DataFrame:
    """Mean of the normalised scores."""
    scaled = normalise(df, scores)
    mean = total_of([F.col(f"{c}_norm") for c in scores]) / len(scores)
    return scaled.select(*[quoted(c) for c in df.columns], mean.alias(name))


def flag_top(
    df: DataFrame, score: str, id_column: str | Sequence[str], share: float, name: str = "flag"
) -> DataFrame:
    """Flag the ``int(n * share)`` rows with the highest score, lower id (of any types) first on ties.

    ``n`` counts rows with a score; rows without one are not flagged.
    """
    return flag_top_of(df, {score: name}, id_column, share)


def flag_top_of(
    df: DataFrame, names: dict[str, str], id_column: str | Sequence[str], share: float
) -> DataFrame:
    """``flag_top`` for several scores in the same passes; ``names`` gives the flag of each score."""
    row = df.agg(*[F.count(F.col(quoted(c))).alias(f"n{i}") for i, c in enumerate(names)]).first()
    counts = {c: int(row[f"n{i}"] * share) for i, c in enumerate(names)}
    top = top_rows_of(df, counts, id_column)
    return df.withColumns({names[c]: F.coalesce(top[c], F.lit(False)).cast("int") for c in names})


def detector_overlap(df: DataFrame, flags: Sequence[str], label: str = "y") -> DataFrame:
    """(region, caught): positives caught by each combination of any number of detectors, and by any.

    A row's flags are the bits of one number, and rows are counted per number: one pass, and no more
    than ``2 ** len(flags)`` counts. A region is ``only`` a detector, several joined by ``+``, or
    ``all``; those that caught nothing are listed with 0.
    """
    bits = [F.when(F.col(quoted(f)) == 1, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(flags)]
    mask = total_of(bits).cast("bigint").alias("mask")
    counted = df.filter(F.col(quoted(label)) == 1).groupBy(mask).agg(F.count(F.lit(1)).alias("caught"))
    every = (1 << len(flags)) - 1
    regions = df.sparkSession.range(1, every + 1).withColumnRenamed("id", "mask")
    regions = regions.join(F.broadcast(counted), "mask", "left")
    held = [F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.lit(f)) for i, f in enumerate(flags)]
    names = F.array_compact(F.array(*held))
    region = (
        F.when(F.col("mask") == every, F.lit("all"))
        .when(F.size(names) == 1, F.concat(F.lit("only "), names[0]))
        .otherwise(F.array_join(names, "+"))
    )
    listed = regions.select(region.alias("region"), F.coalesce("caught", F.lit(0)).cast("bigint").alias("caught"))
    caught = counted.filter("mask > 0").agg(F.coalesce(F.sum("caught"), F.lit(0)).cast("bigint").alias("caught"))
    return listed.unionByName(caught.select(F.lit("any").alias("region"), "caught"))
