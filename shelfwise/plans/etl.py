"""Cleaning pipelines: raw feeds in, clean tables out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import capitalize, parse_price, parse_release_year, title_case, trim_right
from shelfwise.functions.parsing import LONG_TEXT_YEAR
from shelfwise.operators.joins import join_catalog, join_left_dedup, library_items
from shelfwise.operators.ranking import dedup_keep_first, top_per_group
from shelfwise.operators.sentiment import sentiment_class

#: Tasks that add up rows by genre, for each shuffle partition: a row becomes as many as its item has genres.
GENRE_TASKS = 4
REVIEW_FIELDS = ["funny", "posted", "last_edited", "item_id", "helpful", "recommend", "review"]


def clean_catalog(
    raw: DataFrame, order: Sequence[Column] | None = None, long_text_year: int = LONG_TEXT_YEAR
) -> DataFrame:
    """Raw catalog to one typed row per item.

    Of several rows with one id the first in ``order`` counts, whatever becomes of it later.
    """
    typed = raw.dropna(how="all").withColumn("id", F.col("id").try_cast("bigint"))
    first = dedup_keep_first(typed.dropna(subset=["id"]), "id", order)
    return first.select("id", "title", catalog_columns(F.col, long_text_year).alias("c")).select(
        "id", "title", "c.*").dropna(subset=["genres", "price", "release_date", "developer"])


def catalog_columns(of: Callable[[str], Column], long_text_year: int = LONG_TEXT_YEAR) -> Column:
    """The typed columns of a catalog row, from its raw ones; a row without one of them is dropped."""
    genres = F.coalesce(of("genres"), of("tags"))
    return F.struct(
        title_case(trim_right(F.coalesce(of("developer"), of("publisher")))).alias("developer"),
        genres.alias("genres"),
        parse_price(of("price"), genres, of("tags")).alias("price"),
        parse_release_year(of("release_date"), long_text_year).alias("release_date"),
    )


def flatten_reviews(raw: DataFrame) -> DataFrame:
    """One row per review; records without any review drop out."""
    rows = raw.select("user_id", F.explode_outer("reviews").alias("r")).select("user_id", "r.*")
    return rows.dropna(how="all", subset=REVIEW_FIELDS)


def clean_reviews(raw: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Raw reviews to (user_id, item_id, recommend, sentiment_analysis)."""
    rows = flatten_reviews(raw).select(
        "user_id", F.col("item_id").try_cast("bigint").alias("item_id"), "recommend", "review"
    )
    return sentiment_class(rows, "review", lexicon)


def slim_libraries(raw: DataFrame) -> DataFrame:
    """Raw libraries without the columns nothing reads, item ids as numbers."""
    return raw.drop("steam_id", "user_url").withColumn(
        "items",
        F.transform(
            "items",
            lambda i: F.struct(
                i["item_id"].try_cast("bigint").alias("item_id"),
                i["item_name"].alias("item_name"),
                i["playtime_forever"].alias("playtime_forever"),
                i["playtime_2weeks"].alias("playtime_2weeks"),
            ),
        ),
    )


def library_sizes(libraries: DataFrame) -> DataFrame:
    """(user_id, items_count); a library may arrive in several records."""
    return libraries.groupBy("user_id").agg(F.sum("items_count").alias("items_count"))


def genre_hours(libraries: DataFrame, catalog: DataFrame) -> DataFrame:
    """(genre, user_id, year, hours) for all genres in one pass.

    Rows are dealt out by user before they are multiplied by their genres, so that neither these sums nor those of a user
    over the years shuffle a row per genre.
    """
    played = library_items(libraries).select("user_id", "item_id", "playtime_forever")
    # Spellings that differ in capitals only are one genre, and a repeated genre counts once.
    genres = F.array_distinct(F.transform("genres", capitalize))
    items = catalog.select("id", genres.alias("genres"), F.col("release_date").alias("year"))
    tasks = GENRE_TASKS * int(libraries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        join_catalog(played, items, ["genres", "year"])
        .repartition(tasks, "user_id")
        .select(F.explode("genres").alias("genre"), "user_id", "year", "playtime_forever")
        .groupBy("genre", "user_id", "year")
        .agg(F.sum("playtime_forever").alias("hours"))
    )


def genre_leaders(hours: DataFrame) -> DataFrame:
    """(genre, user_id, hours, by_year): the user with most hours of every genre."""
    per_user = hours.groupBy("genre", "user_id").agg(
        F.sum("hours").alias("hours"),
        # One entry per release year.
        F.array_sort(F.collect_list(F.struct("year", "hours"))).alias("by_year"),
    )
    return top_per_group(per_user, ["genre"], [F.desc("hours"), F.asc("user_id")])


def leader_rows(leaders: DataFrame) -> DataFrame:
    """(genre, user_id, year, hours) in rows instead of a nested list."""
    return leaders.select("genre", "user_id", F.inline("by_year"))


def build_interactions(reviews: DataFrame, libraries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Wide table of reviewed and owned items with their catalog data."""
    sized = join_left_dedup(reviews, library_sizes(libraries), "user_id")
    # Placed as the join wants them, so that dropping copies costs no shuffle of its own.
    owned = library_items(libraries).repartition("user_id", "item_id").distinct()
    details = ["genres", "release_date", "price", "developer"]
    wide = join_catalog(sized.join(owned, ["user_id", "item_id"]), catalog, details)
    return wide.select(
        "user_id", "item_id", F.col("recommend").cast("int").alias("recommend"),
        "sentiment_analysis", "items_count", "item_name", "playtime_forever", *details,
    )
