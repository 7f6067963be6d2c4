"""Questions about one developer, user, genre or year, each also answered for all keys at once.

An unknown key gives an empty result; ``lookup_exists`` tells it from a known key without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import capitalize, title_case
from shelfwise.operators.aggregates import free_share, money_sum, recommend_share
from shelfwise.operators.joins import join_catalog, library_items
from shelfwise.operators.ranking import rank_top, top_per_group
from shelfwise.operators.recommender import RatingModel, recommend
from shelfwise.plans.etl import genre_hours, genre_leaders, leader_rows, library_sizes


def _of_developer(catalog: DataFrame, developer: str, match: str) -> DataFrame:
    """Items of a developer. The name must occur exactly; then all names containing it count too,
    unless ``match`` is ``exact``."""
    name = title_case(F.lit(developer))
    if match == "exact":
        return catalog.filter(F.col("developer") == name)
    known = catalog.filter(F.col("developer") == name).select("developer").exists()
    return catalog.filter(F.col("developer").contains(name)).filter(known)


def developer_by_year(catalog: DataFrame) -> DataFrame:
    """Items and free share of every developer and release year."""
    return free_share(catalog, "developer", "release_date")


def developer_years(catalog: DataFrame, developer: str, match: str = "contains") -> DataFrame:
    """Items and free share per release year of one developer."""
    return free_share(_of_developer(catalog, developer, match), "release_date").orderBy("release_date")


def user_summaries(libraries: DataFrame, catalog: DataFrame, reviews: DataFrame) -> DataFrame:
    """Spend, recommendation share and library size of every user with a library.

    The spend adds up the prices of the items the user owns, each item once.
    """
    owned = library_items(libraries).select("user_id", "item_id").distinct()
    spent = join_catalog(owned, catalog, ["price"]).groupBy("user_id").agg(
        money_sum("price").alias("spent")
    )
    return (
        library_sizes(libraries)
        .join(spent, "user_id", "left")
        .join(recommend_share(reviews, "user_id"), "user_id", "left")
        .select(
            "user_id",
            F.coalesce("spent", F.lit(0.0)).alias("spent"),
            "recommend_percent",
            "items_count",
        )
    )


def user_summary(
    libraries: DataFrame, catalog: DataFrame, reviews: DataFrame, user_id: str
) -> DataFrame:
    """The summary of one user, with the texts of the report."""
    mine = F.col("user_id") == user_id
    summary = user_summaries(libraries.filter(mine), catalog, reviews.filter(mine))
    return summary.select(
        "*",
        F.concat(F.col("spent").cast("string"), F.lit(" USD")).alias("spent_text"),
        F.concat(F.col("recommend_percent").cast("string"), F.lit("%")).alias("recommend_text"),
    )


def genre_leader(libraries: DataFrame, catalog: DataFrame, genre: str) -> DataFrame:
    """Hours by release year of the user who played most in a genre."""
    name = capitalize(F.lit(genre))
    items = catalog.filter(F.exists("genres", lambda g: capitalize(g) == name))
    hours = genre_hours(libraries, items).filter(F.col("genre") == name)
    return leader_rows(genre_leaders(hours)).orderBy("year")


def _item_votes(reviews: DataFrame) -> DataFrame:
    """Votes per item. One row per item joins the catalog, however often the item was reviewed."""
    return reviews.groupBy("item_id").agg(
        F.count_if(F.col("recommend")).alias("recommended"),
        F.count_if(F.col("sentiment_analysis") == 2).alias("positive"),
        F.count_if(F.col("sentiment_analysis") == 0).alias("negative"),
    )


def developer_votes(catalog: DataFrame, reviews: DataFrame, *keys: str) -> DataFrame:
    """Recommending, positive and negative reviews and the score per group of catalog items."""
    votes = join_catalog(_item_votes(reviews), catalog, list(keys))
    return (
        votes.groupBy(*keys)
        .agg(F.sum("recommended").alias("recommended"), F.sum("positive").alias("positive"),
             F.sum("negative").alias("negative"))
        .withColumn("score", F.col("recommended") + F.col("positive"))
    )


def best_developers_of_year(catalog: DataFrame, reviews: DataFrame, year: int) -> DataFrame:
    """The three developers with most recommending and positive reviews of a release year."""
    votes = developer_votes(catalog.filter(F.col("release_date") == year), reviews, "developer")
    return rank_top(votes.select("developer", "score"), "score", "developer", 3)


def best_developers_by_year(catalog: DataFrame, reviews: DataFrame) -> DataFrame:
    """The three best developers of every release year."""
    votes = developer_votes(catalog, reviews, "release_date", "developer")
    best = top_per_group(votes, ["release_date"], [F.desc("score"), F.asc("developer")], 3)
    return best.select("release_date", "developer", "score")


def _sentiments(catalog: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Negative and positive reviews per group of catalog items, 0 and 0 for one without reviews."""
    items = catalog.select(F.col("id").alias("item_id"), key)
    votes = items.join(_item_votes(reviews), "item_id", "left")
    return votes.groupBy(key).agg(
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("negative", "positive")]
    )


def developer_sentiments(catalog: DataFrame, reviews: DataFrame) -> DataFrame:
    """Negative and positive reviews of every developer of the catalog."""
    return _sentiments(catalog, reviews, "developer")


def developer_sentiment(
    catalog: DataFrame, reviews: DataFrame, developer: str, match: str = "contains"
) -> DataFrame:
    """Negative and positive reviews of one developer; no row if the developer is unknown."""
    items = _of_developer(catalog, developer, match).withColumn("asked", title_case(F.lit(developer)))
    return _sentiments(items, reviews, "asked").select(
        F.col("asked").alias("developer"), "negative", "positive",
        F.concat(F.lit("Negative = "), F.col("negative")).alias("negative_text"),
        F.concat(F.lit("Positive = "), F.col("positive")).alias("positive_text"),
    )


def user_recommendations(
    model: RatingModel, interactions: DataFrame, user_id: str, k: int = 5, libraries: DataFrame | None = None
) -> DataFrame:
    """The k items recommended to one user, with their names.

    Candidates and names come from ``model.items``, one row an item, if it was fitted with names; of the wide table only the
    user's rows are read then. What the user owns are these rows' items, or, with ``libraries``, all items of the user's
    library. A user without rows in the wide table gets none.
    """
    own = F.col("user_id") == user_id
    mine = interactions.filter(own).select("user_id", "item_id")
    if libraries is not None:
        whole = library_items(libraries.filter(own)).select("user_id", "item_id")
        mine = mine.unionByName(whole.join(mine.select("user_id").distinct(), "user_id", "left_semi"))
    if "item_name" in model.items.columns:
        names = model.items.select("item_id", "item_name")
    else:
        names = interactions.groupBy("item_id").agg(F.min("item_name").alias("item_name"))
    best = recommend(model, mine, k, user_id, candidates=names)
    return best.join(names, "item_id").select("user_id", "place", "item_id", "item_name", "estimate")
