"""Cutting lineage: what an iterative operator has made so far is written once and read from there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The reliable folder that the session names in ``spark.checkpoint.dir``.

    Where it names none, a local master (tests) gets a temporary one; a cluster, whose machines share no such folder, an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="chronolake-checkpoint-"))
    return context.getCheckpointDir()


#: Rows that a task brings together, at about.
ROWS_OF_TASK = 400_000


def parts_of(spark: SparkSession, rows: int, of_task: int = ROWS_OF_TASK) -> int | None:
    """Parts that ``rows`` rows are dealt into, so that a task's share doesn't grow with the table; None while the cores are enough."""
    parts = -(-rows // of_task)
    return parts if parts > spark.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``df`` brought together by ``keys``, in ``parts`` parts or as many as the session finds fit."""
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)


#: Rows of two or three numbers that lie in one part, at about.
SHORT_ROWS = 100_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` short rows, in no more parts than these fill: one for each core at least.

    Iterations over few rows then write a few files a round, whatever the session's number of shuffle partitions.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // SHORT_ROWS)))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, and read from there: its lineage ends, and lost executors cost nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
