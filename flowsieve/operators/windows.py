"""Tumbling time windows over events and scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.session import written

from flowsieve.functions.columns import ratio


def port_counts(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Bytes, records and failures per window, source and port.

    Grouping by port first spreads a busy source over its ports and turns the count of distinct
    ports into a plain count afterwards. Works on batch and streaming tables.
    """
    return df.groupBy(*keys, "dst_port").agg(
        F.sum("n_bytes").alias("bytes"),
        F.count(F.lit(1)).alias("packets"),
        F.sum("failed").alias("failures"),
    )


def window_totals(ports: DataFrame, keys: list[Column]) -> DataFrame:
    return ports.groupBy(*keys).agg(
        F.sum("bytes").alias("n_bytes"),
        F.sum("packets").alias("n_packets"),
        F.count("dst_port").alias("n_dst_ports"),
        ratio(F.sum("failures"), F.sum("packets")).alias("failed_ratio"),
    )


def window_features(
    df: DataFrame, window: str = "5 minutes", time: str = "ts", source: str = "src"
) -> DataFrame:
    """Traffic features per source and window: bytes, records, distinct ports, share of failures."""
    start = F.window(time, window)["start"].alias("window_start")
    ports = port_counts(df, [start, F.col(source)])
    return window_totals(ports, [F.col("window_start"), F.col(source)])


def resample(
    df: DataFrame,
    window: str = "5 minutes",
    time: str = "ts",
    rate: str = "flow_byts_s",
    packets: str = "total_pkts",
    resets: str = "rst_flag",
    score: str = "if_score",
) -> DataFrame:
    """Series over all bins from first to last: mean rate, sums, lowest score.

    Empty bins get 0, but no score. The full list of bins depends on the time range only.
    """
    bins = df.groupBy(F.window(time, window)["start"].alias("bin")).agg(
        F.avg(rate).alias("mean_rate"),
        F.sum(packets).alias("packets"),
        F.sum(resets).alias("resets"),
        F.min(score).alias("min_score"),
    )
    bins = written(bins, "bins")
    ends = bins.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    every = ends.select(
        F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {window}"))).alias("bin")
    )
    return every.join(bins, "bin", "left").select(
        "bin",
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean_rate", "packets", "resets")],
        "min_score",
    )


def time_range(df: DataFrame, time: str = "ts") -> DataFrame:
    """Number of records and the range as ``yyyy-MM-dd HH:mm – HH:mm``."""
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        F.concat(
            F.date_format(F.min(time), "yyyy-MM-dd HH:mm"),
            F.lit(" – "),
            F.date_format(F.max(time), "HH:mm"),
        ).alias("time_range"),
    )
