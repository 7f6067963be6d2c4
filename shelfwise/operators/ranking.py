"""Top-k, first rows per group, ordered samples. Ties go to the smaller key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, measure: str, key: str, k: int) -> DataFrame:
    """The k rows with the largest measure."""
    return df.orderBy(F.desc(measure), F.asc(key)).limit(k)


def rank_top(df: DataFrame, measure: str, key: str, k: int = 3, alias: str = "place") -> DataFrame:
    """The k rows with the largest measure, numbered from 1."""
    best = top_k(df, measure, key, k)
    order = Window.orderBy(F.desc(measure), F.asc(key))
    return best.select(F.row_number().over(order).alias(alias), "*")


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int = 1
) -> DataFrame:
    """The first k rows of every group in the given order.

    The bound on the row number is applied before the shuffle as well: a task sends at most k rows
    of a group, however large the group is.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= k).drop("_rank")


def dedup_keep_first(df: DataFrame, key: str, order: Sequence[Column] | None = None) -> DataFrame:
    """One row per key: the first in ``order``, by default in the order of all other columns."""
    return top_per_group(
        df, [key], order or [F.col(c).asc_nulls_first() for c in df.columns if c != key]
    )


def sample_matching(
    df: DataFrame, column: str, text: str, key: str, columns: Sequence[str], limit: int = 15
) -> DataFrame:
    """The first rows, by key, whose list holds an element containing ``text``."""
    matching = df.filter(F.exists(column, lambda x: x.contains(text)))
    return matching.select(key, *columns).orderBy(key).limit(limit)
