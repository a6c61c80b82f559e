"""Windowed traffic features over an unbounded table of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.operators.windows import port_counts, window_totals


def stream_window_features(
    records: DataFrame,
    window: str = "5 minutes",
    delay: str = "10 minutes",
    time: str = "ts",
    source: str = "src",
) -> DataFrame:
    """The batch features per source and window, emitted once a window is ``delay`` behind.

    Two chained aggregations, as in the batch form, so state holds one row per window, source and
    port seen, and is dropped with the watermark. Write it out in append mode.
    """
    # Watermarks exist for timestamps with a time zone only.
    marked = records.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    ports = port_counts(marked, [F.window(time, window).alias("_window"), F.col(source)])
    again = F.window(F.window_time("_window"), window).alias("_window")
    totals = window_totals(ports, [again, F.col(source)])
    return totals.select(F.col("_window.start").alias("window_start"), *totals.columns[1:])
