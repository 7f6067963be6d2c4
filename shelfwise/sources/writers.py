"""Sinks of the clean tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_json_gz(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def write_csv_gz(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns are written as JSON text."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    flat = [
        F.to_json(field.name).alias(field.name)
        if isinstance(field.dataType, nested)
        else F.col(field.name)
        for field in df.schema.fields
    ]
    (
        df.select(*flat)
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("compression", "gzip")
        .csv(path)
    )


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, lookup: str | None = None) -> None:
    """Snappy Parquet; ``partition_by`` names the columns readers filter on.

    ``lookup`` is a column of many values of which readers ask for one, such as a user: rows are dealt to files by its ranges and
    sorted by it, and it gets Bloom filters, so a question for one value reads the row groups that may hold it and skips
    the rest. Rows of one value may fill several files, so a value with very many rows is no burden.
    """
    writer = df
    if lookup is not None:
        rest = F.xxhash64(*[c for c in df.columns if c != lookup])
        writer = df.repartitionByRange(F.col(lookup), rest).sortWithinPartitions(lookup)
    writer = writer.write.mode("overwrite").option("compression", "snappy")
    if lookup is not None:
        writer = writer.option(f"parquet.bloom.filter.enabled#{lookup}", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
