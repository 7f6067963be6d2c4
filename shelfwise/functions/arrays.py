"""Nested columns: lists, records and maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_nested(df: DataFrame, column: str, alias: str) -> DataFrame:
    """One row per list element; an empty or missing list keeps one row with NULL."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode_outer(column).alias(alias))


def expand_struct(df: DataFrame, column: str) -> DataFrame:
    """The fields of a record column as columns of their own."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, f"{column}.*")


def distinct_array_elements(df: DataFrame, column: str, alias: str) -> DataFrame:
    return df.select(F.explode(column).alias(alias)).distinct()


def one_hot_array(df: DataFrame, column: str, values: Sequence[str], prefix: str = "") -> DataFrame:
    """One 0/1 column per given value, telling whether the list holds it."""
    return df.select(
        "*",
        *[
            F.coalesce(F.array_contains(column, v).cast("int"), F.lit(0)).alias(prefix + v)
            for v in values
        ],
    )


def build_year_map(entries: Column) -> Column:
    """``array<struct<year, hours>>`` to a map of labelled texts, entered in year order."""
    return F.map_from_entries(
        F.transform(
            F.array_sort(entries),
            lambda e: F.struct(
                F.concat(F.lit("Year "), e["year"].cast("string")),
                F.concat(F.lit("Hours: "), e["hours"].cast("string")),
            ),
        )
    )


def parse_nested_ids(items_json: Column) -> Column:
    """Item ids out of a list of records stored as JSON text; ids that are no number are NULL."""
    records = F.from_json(items_json, "array<struct<item_id: string>>")
    return F.transform(records, lambda r: r["item_id"].try_cast("bigint"))
