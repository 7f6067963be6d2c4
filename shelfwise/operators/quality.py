"""Checks of a raw feed: missing values, empty columns, repeated keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls) for every column, in one pass."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counted.unpivot([], df.columns, "column", "nulls")


def column_profile(df: DataFrame) -> DataFrame:
    """(column, type, non_null) for every column, in one pass."""
    types = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    counted = df.agg(*[F.count(c).alias(c) for c in df.columns])
    long = counted.unpivot([], df.columns, "column", "non_null")
    return long.select("column", types[F.col("column")].alias("type"), "non_null")


def distinct_counts(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """(column, distinct_values) for the given columns.

    The exact count keeps one entry per value of a column; the approximate one a fixed sketch.
    """
    count = F.count_distinct if exact else F.approx_count_distinct
    counted = df.agg(*[count(F.col(c)).alias(c) for c in columns])
    return counted.unpivot([], columns, "column", "distinct_values")


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop the columns that are NULL in every row."""
    # The columns of the result must be known when the plan is built: one row of counts.
    filled = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if filled[c] == 0])


def duplicate_key_report(df: DataFrame, key: str) -> DataFrame:
    """(repeated, keys): how many keys occur once and how many more often."""
    per_key = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return per_key.groupBy((F.col("n") > 1).alias("repeated")).agg(F.count("*").alias("keys"))


def value_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): how often each value of each column occurs, as text, NULL counted as a value of its own.

    One scan and one shuffle for all columns; equal values are counted in every task first.
    """
    def text(c: str) -> Column:
        kind = df.schema[c].dataType
        return F.to_json(c) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else F.col(c).cast("string")

    pairs = F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("value")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count("*").alias("n"))
