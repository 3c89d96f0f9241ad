"""The folder that driver and executors share, and tables cut from their lineage there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Slim rows that are worth a task of their own.
ROWS_A_TASK = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.  Only a local session may go without; it gets a temporary folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tracklake-checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of at most ``rows`` slim rows, in one partition a core if these are few, else as it is.

    Each task that shuffles leaves three files and an event, however little it writes: in work of many rounds over a small
    table that outgrows the data where a shuffle has hundreds of partitions.  The hashing of the shuffle itself stays.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(cores) if rows <= cores * ROWS_A_TASK else df
