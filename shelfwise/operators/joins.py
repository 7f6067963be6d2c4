"""Joins of reviews, libraries and catalog.

No side is forced into a broadcast: the optimizer broadcasts a side whose measured size is below
its threshold and otherwise shuffles both, where adaptive execution splits the partition of a hot
item. Callers that need only group totals aggregate per item first and join one row per item.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_catalog(
    rows: DataFrame, catalog: DataFrame, columns: Sequence[str], key: str = "item_id"
) -> DataFrame:
    """Rows with the given columns of their catalog item; rows of unknown items drop out."""
    items = catalog.select(F.col("id").alias(key), *columns)
    return rows.join(items, key)


def library_items(libraries: DataFrame) -> DataFrame:
    """(user_id, item_id, item_name, playtime_forever): one row per item of a library."""
    return (
        libraries.select("user_id", F.explode("items").alias("item"))
        .select("user_id", "item.item_id", "item.item_name", "item.playtime_forever")
        .filter(F.col("item_id").isNotNull())
    )


def join_left_dedup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join without rows that are equal in every column.

    Copies are dropped on both sides before the join; distinct rows cannot join to equal ones.
    """
    return left.distinct().join(right.distinct(), key, "left")


def anti_join_owned(candidates: DataFrame, owned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates without those already owned."""
    return candidates.join(owned.select(*keys).distinct(), list(keys), "left_anti")


def lookup_exists(asked: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Every asked key with ``known``: whether the table holds it."""
    held = table.select(key).distinct().withColumn("known", F.lit(True))
    return (
        asked.select(key)
        .distinct()
        .join(held, key, "left")
        .select(key, F.coalesce("known", F.lit(False)).alias("known"))
    )
