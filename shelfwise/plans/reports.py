"""Reports on the wide interaction table and on a raw feed.

``grain="row"`` counts reviews, ``grain="item"`` counts every item once.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.aggregates import (
    box_stats,
    count_by_element,
    histogram,
    sum_by_group,
    value_counts,
)
from shelfwise.operators.quality import value_frequencies
from shelfwise.operators.ranking import top_k
from shelfwise.plans.etl import catalog_columns


def _at_grain(interactions: DataFrame, column: str, grain: str) -> DataFrame:
    if grain == "row":
        return interactions
    return interactions.select("item_id", column).distinct()


def _top_items(interactions: DataFrame, measure: str, k: int) -> DataFrame:
    return top_k(sum_by_group(interactions, ["item_name"], [measure]), measure, "item_name", k)


def top_playtime(interactions: DataFrame, k: int = 5) -> DataFrame:
    return _top_items(interactions, "playtime_forever", k)


def top_recommended(interactions: DataFrame, k: int = 5) -> DataFrame:
    return _top_items(interactions, "recommend", k)


def top_sentiment(interactions: DataFrame, k: int = 5) -> DataFrame:
    return _top_items(interactions, "sentiment_analysis", k)


def price_distribution(interactions: DataFrame, bins: int = 30, grain: str = "row") -> DataFrame:
    """Histogram rows (``part`` bin) and box-plot rows (``part`` box) as (part, name, value)."""
    rows = _at_grain(interactions, "price", grain)
    bars = histogram(rows, "price", bins).select(
        F.lit("bin").alias("part"),
        F.lpad(F.col("bin").cast("string"), 3, "0").alias("name"),
        F.col("n").cast("double").alias("value"),
    )
    figures = box_stats(rows, "price")
    box = figures.select([F.col(c).cast("double") for c in figures.columns]).unpivot(
        [], figures.columns, "name", "value"
    )
    return bars.unionByName(box.select(F.lit("box").alias("part"), "name", "value"))


def genre_counts(interactions: DataFrame, grain: str = "row") -> DataFrame:
    return count_by_element(_at_grain(interactions, "genres", grain), "genres", "genre")


def top_genres(interactions: DataFrame, k: int = 5, grain: str = "row") -> DataFrame:
    return top_k(genre_counts(interactions, grain), "n", "genre", k)


def counts_by_year(interactions: DataFrame, grain: str = "row") -> DataFrame:
    rows = _at_grain(interactions, "release_date", grain)
    return value_counts(rows, "release_date").orderBy("release_date")


def recommend_counts(interactions: DataFrame) -> DataFrame:
    return value_counts(interactions, "recommend")


def sentiment_counts(interactions: DataFrame) -> DataFrame:
    return value_counts(interactions, "sentiment_analysis")


def data_quality(raw: DataFrame, key: str, columns: list[str], usual: dict[str, str]) -> DataFrame:
    """(check, subject, value): rows missing per column, distinct values, repeated keys, and values
    that do not match the usual pattern of their column. All of it is read off the values' frequencies, one scan."""
    column, value, n = F.col("column"), F.col("value"), F.col("n")
    odd = reduce(or_, [(column == c) & ~value.rlike(p) for c, p in usual.items()], F.lit(False))
    repeated = F.when(n > 1, "repeated").otherwise("single")

    def adds(check: str, subject: Column, amount: Column) -> Column:
        return F.struct(F.lit(check).alias("check"), subject.alias("subject"), amount.cast("bigint").alias("value"))

    # What one value adds to the checks it matters to.
    every = F.array(
        adds("missing", column, F.when(value.isNull(), n).otherwise(0)),
        F.when(column.isin(columns), adds("distinct", column, value.isNotNull().cast("int"))),
        F.when((column == key) & value.isNotNull(), adds("key", repeated, F.lit(1))),
        F.when(column.isin(list(usual)), adds("unusual", column, F.when(odd, n).otherwise(0))),
    )
    counted = value_frequencies(raw, raw.columns).select(F.explode(every).alias("add")).filter("add is not null")
    return counted.groupBy("add.check", "add.subject").agg(F.sum("add.value").alias("value"))


def dropped_rows(raw: DataFrame, order: list[str]) -> DataFrame:
    """(reason, n): what becomes of the rows of a raw catalog, ``kept`` or the first rule that drops them.

    Of several rows with one id the first by ``order`` counts. Rows of an id are counted and the first of them found in one
    aggregate, before the shuffle too, so an id with very many rows is no burden.
    """
    empty = reduce(and_, [F.col(c).isNull() for c in raw.columns])
    typed = raw.withColumn("id", F.col("id").try_cast("bigint")).withColumn("empty", empty)
    found = typed.groupBy("id", "empty").agg(
        F.count("*").alias("n"), F.min(F.struct(*order, *[c for c in raw.columns if c not in order])).alias("first")
    )
    cleaned = found.select("id", "empty", "n", "first", catalog_columns(lambda c: F.col("first").getField(c)).alias("c"))
    reason = reduce(
        lambda done, c: done.when(F.col("c").getField(c).isNull(), f"no {c}"), ["price", "release_date", "developer"],
        F.when(F.col("c.genres").isNull(), "no genres"),
    ).otherwise("kept")
    counts = F.when(F.col("empty"), F.array(F.struct(F.lit("empty").alias("reason"), F.col("n")))).when(
        F.col("id").isNull(), F.array(F.struct(F.lit("no id").alias("reason"), F.col("n")))).otherwise(F.array(
            F.struct(reason.alias("reason"), F.lit(1).cast("bigint").alias("n")),
            F.struct(F.lit("repeated id").alias("reason"), (F.col("n") - 1).alias("n"))))
    return cleaned.select(F.inline(counts)).groupBy("reason").agg(F.sum("n").alias("n")).filter("n > 0")
