"""Intermediates in the folder that driver and executors share, and bounds of what travels."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from turnloom.sources.shared import release, shared_dir
from turnloom.sources.shared import written as materialize

__all__ = ["by_input", "in_files", "materialize", "release", "shared_dir", "small_batches", "sweep", "unused"]


def in_files(df: DataFrame, rows: int, per_file: int = 1 << 16) -> DataFrame:
    """As many partitions as about ``rows`` narrow rows need, so that a small table is not many small files."""
    return df.coalesce(max(1, -(-rows // per_file)))


def by_input(df: DataFrame, source: DataFrame, per_file: int = 8 << 20) -> DataFrame:
    """As many partitions as the bytes of the files that ``source`` reads call for, if that is fewer."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(max(1, min(-(-size // per_file), 1 << 20)))


def sweep(spark: SparkSession) -> None:
    """Have the driver collect garbage, so that Spark's cleaner deletes the shuffle files of steps that are done.

    Spark does so by itself every half hour; steps of a long operator are shorter than that."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch may hold: texts of any length travel in it.

    The bound is the session's and stays, as frames built under it run later."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
