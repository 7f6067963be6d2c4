"""Where jobs write intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for ``name`` below the shared folder the cluster names.

    ``spark.checkpoint.dir`` must be reachable by every executor. Only where it is unset (local
    tests) is a folder of this machine used, and then it is set for the whole session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="shelfwise-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/shelfwise/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffle_files_end_with_the_job(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stored_table(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there, and a lost executor costs nothing of it.

    So the shuffle files that made it go as soon as it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffle_files_end_with_the_job(spark):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(table: DataFrame) -> None:
    """Remove a table that ``stored_table`` gave, once nothing reads it any more."""
    spark = table.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles() if "/shelfwise/" in f}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
