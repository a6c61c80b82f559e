"""A stored detector applied to an unbounded table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from flowsieve.plans.detect import FittedForest
from flowsieve.plans.stored import load_fit


def scored_stream(rows: DataFrame, fit_folder: str, folder: str, checkpoint: str) -> DataStreamWriter:
    """A writer that adds ``if_score`` and ``flag`` of the stored forest to each new row.

    ``rows`` is a streaming table with the columns that the forest was fitted on, such as
    ``stream_window_features``. The caller sets the trigger and starts it. Every micro-batch goes to a
    folder of its own, named by its number, and replaces what stands there: a batch that is repeated
    after a failure leaves one copy.
    """
    detector = load_fit(rows.sparkSession, fit_folder)

    def write(batch: DataFrame, number: int) -> None:
        write_batch(batch, number, detector, folder)

    return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)


def write_batch(batch: DataFrame, number: int, detector: FittedForest, folder: str) -> None:
    detector.run(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")


def read_scored(spark: SparkSession, folder: str) -> DataFrame:
    """All rows written so far, with the number of their ``batch``."""
    return spark.read.parquet(folder)
