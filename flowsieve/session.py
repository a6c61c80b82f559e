"""The shared scratch folder, and intermediate tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCRATCH_SETTING = "spark.checkpoint.dir"

# Rows one task may sort on its own. Anything that can exceed it is split first. The setting lets a
# session lower it, as the checks of the split paths do.
TASK_ROWS = 1_000_000
TASK_ROWS_SETTING = "flowsieve.taskRows"

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Rows of a lookup table that may be broadcast without a second thought.
BROADCAST_ROWS = 10_000

_local_scratch: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from the session's ``spark.checkpoint.dir``.

    Only a ``local`` session, as in tests, gets a temporary folder when the setting is missing.
    """
    context = spark.sparkContext
    folder = spark.conf.get(SCRATCH_SETTING, None) or context.getConf().get(SCRATCH_SETTING)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {SCRATCH_SETTING} to a folder shared by all executors")
        if context.applicationId not in _local_scratch:
            _local_scratch[context.applicationId] = tempfile.mkdtemp(prefix="flowsieve-")
        folder = _local_scratch[context.applicationId]
    return f"{folder.rstrip('/')}/flowsieve/{context.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"


def task_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(TASK_ROWS_SETTING, str(TASK_ROWS)))


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to the scratch folder. Tables read from it are gone then."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back, so that later jobs neither recompute nor lose it."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_lean(df: DataFrame, label: str) -> DataFrame:
    """``written``, with the files that were shuffled for it removed as soon as the table stands.

    Else they stay on the executors' disks until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return written(df, label)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def drop_written(*tables: DataFrame) -> None:
    """Delete the written tables that these read, while the application goes on. Nothing may read them any more.

    Files outside the scratch folder, as the application's inputs, are left alone.
    """
    for df in tables:
        context = df.sparkSession.sparkContext
        path_of = context._jvm.org.apache.hadoop.fs.Path
        scratch = path_of(scratch_folder(df.sparkSession)).toUri().getPath() + "/"
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = path_of(folder)
            if path.toUri().getPath().startswith(scratch):
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def with_checkpoints(spark: SparkSession) -> None:
    """Give MLlib's iterative fits a checkpoint folder when the cluster has named none."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(f"{scratch_folder(spark)}/checkpoints")


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` fetched and marked for broadcast if it has at most ``rows`` rows, else marked for a sorted join.

    An aggregation's size is unknown to the planner, which would shuffle both sides of a join on it. A
    written table's size is that of its compressed files, which can be many times as large in memory.
    """
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        return df.hint("merge")
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema))
