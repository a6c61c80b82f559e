"""Cleaning and feature preparation: fit on one table, apply to any other."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions.columns import (
    finite_or_null,
    log1p_clipped,
    not_below_zero,
    number_or_zero,
    quoted,
)
from flowsieve.operators.ordering import grouped_quantile, hash_positions, quantiles, running_sums
from flowsieve.session import broadcast_if_small, written

DAY_MICROSECONDS = 24 * 3600 * 1_000_000


def featurise(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The ten model features from a flow file's columns (text or numbers)."""
    n = number_or_zero
    return rows.select(
        *[quoted(c) for c in keep],
        not_below_zero(n("Flow Byts/s")).alias("flow_byts_s"),
        not_below_zero(n("Flow Pkts/s")).alias("flow_pkts_s"),
        n("TotLen Fwd Pkts").alias("fwd_bytes"),
        n("TotLen Bwd Pkts").alias("bwd_bytes"),
        (n("Tot Fwd Pkts") + n("Tot Bwd Pkts")).alias("total_pkts"),
        n("SYN Flag Cnt").alias("syn_flag"),
        n("RST Flag Cnt").alias("rst_flag"),
        n("FIN Flag Cnt").alias("fin_flag"),
        (n("Flow Duration") / 1e6).alias("flow_duration_s"),
        n("Pkt Len Mean").alias("pkt_len_mean"),
    )


def spread_over_day(
    df: DataFrame, ids: Sequence[str], start: str = "2024-01-15 00:00:00", name: str = "timestamp"
) -> DataFrame:
    """Give the rows, in shuffled order, evenly spaced times over 24 hours."""
    n = df.count()
    placed = hash_positions(df, ids, name="_position")
    # The step has microsecond resolution, so round it once and multiply.
    step = round(DAY_MICROSECONDS / n) if n else 0
    begin = F.lit(start).cast("timestamp_ntz")
    moment = F.timestamp_add("MICROSECOND", F.col("_position") * F.lit(step), begin)
    return placed.withColumn(name, moment).drop("_position")


@dataclass(frozen=True)
class Prep:
    """Fitted preparation. Holds a few numbers per column, whatever the size of the table."""

    columns: tuple[str, ...]
    medians: dict[str, float]
    variances: dict[str, float]
    skews: dict[str, float | None]
    kept: tuple[str, ...]
    skewed: tuple[str, ...]
    means: dict[str, float]
    deviations: dict[str, float]

    def imputed(self, column: str, medians: dict[str, float] | None = None) -> Column:
        fill = (medians or self.medians)[column]
        return F.coalesce(finite_or_null(column), F.lit(fill))

    def shaped(self, column: str, medians: dict[str, float] | None = None) -> Column:
        """Imputed, and logged when the column was found skewed."""
        value = self.imputed(column, medians)
        return log1p_clipped(value) if column in self.skewed else value

    def scaled(self, column: str, medians: dict[str, float] | None = None) -> Column:
        return (self.shaped(column, medians) - F.lit(self.means[column])) / F.lit(
            self.deviations[column]
        )

    def transform(
        self,
        df: DataFrame,
        keep: Sequence[str] = (),
        medians: dict[str, float] | None = None,
    ) -> DataFrame:
        """Kept columns standardised, next to the ``keep`` columns. One projection, no shuffle."""
        return df.select(
            *[quoted(c) for c in keep], *[self.scaled(c, medians).alias(c) for c in self.kept]
        )

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (
                c,
                self.medians[c],
                self.variances[c],
                self.skews[c],
                c in self.kept,
                c in self.skewed,
                self.means.get(c),
                self.deviations.get(c),
            )
            for c in self.columns
        ]
        return spark.createDataFrame(
            rows,
            "feature string, median double, variance double, skew double, kept boolean, "
            "skewed boolean, mean double, sd double",
        )


def fit_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Median of the finite values of each column (0 where there are none)."""
    finite = df.select(*[finite_or_null(c).alias(c) for c in columns])
    return {c: q[0] if q[0] is not None else 0.0 for c, q in quantiles(finite, columns, [0.5]).items()}


def fit_prep(
    df: DataFrame,
    columns: Sequence[str],
    two_sided: bool = True,
    impute: str = "median",
    drop_constant: bool = True,
    log_skewed: bool = True,
    skew_limit: float = 2.0,
) -> Prep:
    """Fit in two passes over ``df``: medians, then the moments of plain and logged columns.

    ``impute`` is ``median`` or ``zero``. ``two_sided`` also logs columns with a long left tail.
    """
    medians = fit_medians(df, columns) if impute == "median" else dict.fromkeys(columns, 0.0)
    aggregates = []
    for i, c in enumerate(columns):
        plain = F.coalesce(finite_or_null(c), F.lit(medians[c]))
        logged = log1p_clipped(plain)
        aggregates += [
            F.var_samp(plain).alias(f"v{i}"),
            F.skewness(plain).alias(f"g{i}"),
            F.avg(plain).alias(f"m{i}"),
            F.stddev_pop(plain).alias(f"s{i}"),
        ]
        if log_skewed:
            aggregates += [F.avg(logged).alias(f"ml{i}"), F.stddev_pop(logged).alias(f"sl{i}")]
    row = df.agg(F.count(F.lit(1)).alias("n"), *aggregates).first()
    n = row.n
    variances = {c: row[f"v{i}"] or 0.0 for i, c in enumerate(columns)}
    skews = {c: adjusted_skew(row[f"g{i}"], n) for i, c in enumerate(columns)}
    kept = tuple(c for c in columns if variances[c] > 0 or not drop_constant)
    skewed = tuple(
        c
        for c in kept
        if log_skewed
        and skews[c] is not None
        and (abs(skews[c]) if two_sided else skews[c]) > skew_limit
    )
    place = {c: i for i, c in enumerate(columns)}
    means = {c: row[f"{'ml' if c in skewed else 'm'}{place[c]}"] for c in kept}
    deviations = {c: row[f"{'sl' if c in skewed else 's'}{place[c]}"] or 1.0 for c in kept}
    return Prep(tuple(columns), medians, variances, skews, kept, skewed, means, deviations)


def adjusted_skew(population_skew: float | None, n: int) -> float | None:
    """Sample skewness with the usual bias correction; Spark's built-in is the population form."""
    if population_skew is None or math.isnan(population_skew) or n < 3:
        return None
    return population_skew * math.sqrt(n * (n - 1)) / (n - 2)


def winsorise(
    df: DataFrame, columns: Sequence[str], share: float = 0.995, by: str | None = None
) -> DataFrame:
    """Cut values above the ``share`` quantile, of the row's class in column ``by`` if given.

    NULLs stay NULL.
    """

    def cut(c: str, cap: Column) -> Column:
        return F.when(F.col(quoted(c)).isNotNull(), F.least(F.col(quoted(c)), cap))

    if by is None:
        caps = quantiles(df, columns, [share])
        return df.withColumns({c: cut(c, F.lit(caps[c][0])) for c in columns})
    named = {c: f"_cap{i}" for i, c in enumerate(columns)}
    caps = grouped_quantile(df, columns, share, by).withColumnsRenamed({**named, by: "_class"})
    joined = df.join(
        broadcast_if_small(caps), F.col(quoted(by)).eqNullSafe(F.col("_class")), "left"
    )
    return joined.select(
        *[
            cut(c, F.col(named[c])).alias(c) if c in named else F.col(quoted(c))
            for c in df.columns
        ]
    )


def label_codes(df: DataFrame, column: str, name: str = "class_id") -> DataFrame:
    """(``column``, id from 0): the distinct non-NULL values in order.

    Any number of them: beyond what one task may sort they are range-partitioned, numbered inside their
    range, and shifted by the counts of the ranges before.
    """
    kinds = df.select(F.col(quoted(column)).alias("_class")).filter(F.col("_class").isNotNull()).distinct()
    placed = running_sums(kinds.withColumn("_one", F.lit(1).cast("bigint")), "_class", ["_one"])
    return placed.select(F.col("_class").alias(column), (F.col("cum__one") - 1).alias(name))


def encode_labels(df: DataFrame, column: str, name: str = "class_id") -> DataFrame:
    """Class names to ids from 0 in alphabetical order."""
    codes = written(label_codes(df, column, name), "codes").withColumnRenamed(column, "_class")
    codes = broadcast_if_small(codes)
    return df.join(codes, F.col(quoted(column)) == F.col("_class"), "left").drop("_class")


def decode_labels(df: DataFrame, ids: str, codes: DataFrame, column: str, name: str) -> DataFrame:
    """Class ids back to names, given a table of (``ids``, ``column``)."""
    names = codes.select(F.col(ids).alias("_id"), F.col(column).alias(name)).distinct()
    names = broadcast_if_small(names)
    return df.join(names, F.col(ids) == F.col("_id"), "left").drop("_id")
