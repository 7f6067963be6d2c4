"""Intermediate tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from shelfwise.sources.scratch import scratch_path, shuffle_files_end_with_the_job


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir`` and read back: its lineage ends there.

    The table outlives lost executors, so the shuffle files that made it go as soon as it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffle_files_end_with_the_job(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def one_row_at_a_time(spark: SparkSession) -> Iterator[None]:
    """Rows of some megabytes go to Python one by one; else a batch of 64 MB is in memory there twice, and in the JVM."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, "1")
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)
