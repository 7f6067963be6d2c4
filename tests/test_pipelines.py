import pytest
from pyspark.sql import functions as F

from shelfwise import schemas
from shelfwise.operators import joins
from shelfwise.plans import etl, reports, views


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def raw_catalog(spark, *items):
    base = {"genres": ["Action"], "price": "1.5", "release_date": "2010-01-01", "developer": "acme"}
    return spark.createDataFrame([{**base, **i} for i in items], schemas.CATALOG_RAW)


def test_catalog_keeps_the_first_row_of_an_id(spark):
    raw = raw_catalog(
        spark, {"id": "1", "url": "b", "title": "late"}, {"id": "1", "url": "a", "title": "first"},
        {"id": None, "url": "c"}, {"id": None, "url": "d"}, {"id": "x", "url": "e"},
    )
    clean = etl.clean_catalog(raw, [F.asc("url")])
    assert rows(clean.select("id", "title")) == [(1, "first")]


def test_the_first_row_of_an_id_counts_even_if_it_is_dropped_later(spark):
    raw = raw_catalog(spark, {"id": "1", "url": "a", "price": None}, {"id": "1", "url": "b"})
    assert etl.clean_catalog(raw, [F.asc("url")]).count() == 0


def test_catalog_fills_and_drops(spark):
    raw = raw_catalog(
        spark, {"id": "1", "developer": None, "publisher": "acme  "},
        {"id": "2", "developer": None, "publisher": None},
        {"id": "3", "genres": None, "tags": ["X"]}, {"id": "4", "genres": None, "tags": None},
        {"id": "5", "release_date": "TBA"},
    )
    clean = etl.clean_catalog(raw)
    assert rows(clean.select("id", "developer", "genres")) == [
        (1, "Acme", ["Action"]), (3, "Acme", ["X"])]
    assert [(f.name, f.dataType) for f in clean.select(schemas.CATALOG.names).schema] == [
        (f.name, f.dataType) for f in schemas.CATALOG]


def test_reviews(spark):
    lexicon = spark.createDataFrame([("great", 3.1)], schemas.LEXICON)
    review = {"item_id": "7", "recommend": True, "review": "great"}
    raw = spark.createDataFrame([
        {"user_id": "u1", "reviews": [review, review, {"item_id": "8", "recommend": False}]},
        {"user_id": "u2", "reviews": []}, {"user_id": "u3", "reviews": None},
    ], schemas.REVIEWS_RAW)
    clean = etl.clean_reviews(raw, lexicon).select(schemas.REVIEWS.names)
    assert rows(clean) == [("u1", 7, True, 2), ("u1", 7, True, 2), ("u1", 8, False, 1)]


@pytest.fixture(scope="module")
def shop(spark):
    catalog = spark.createDataFrame([
        (1, "One", "Acme", ["Indie", "Indie", "RPG"], 10.0, 2010),
        (2, "Two", "Acme Games", ["Rpg", "RPG"], 0.0, 2010),
        (3, "Three", "Other", ["Action"], 5.25, 2011),
        (4, "Four", "Silent", ["Action"], 1.0, 2012),
    ], schemas.CATALOG)
    libraries = spark.createDataFrame([
        ("u1", 3, [(1, "One", 5, 0), (2, "Two", 4, 0), (9, "Gone", 99, 0)]),
        ("u2", 1, [(1, "One", 9, 0)]),
        ("u2", 1, [(3, "Three", 1, 0)]),
        ("u3", 0, []),
    ], schemas.LIBRARIES)
    reviews = spark.createDataFrame([
        ("u1", 1, True, 2), ("u1", 1, True, 2), ("u1", 2, False, 0), ("u2", 3, False, 1),
        ("u2", 9, True, 2), ("u4", 1, True, 0),
    ], schemas.REVIEWS)
    return catalog, libraries, reviews


def test_interactions(shop):
    catalog, libraries, reviews = shop
    wide = etl.build_interactions(reviews, libraries, catalog)
    # The copy of a review, what is not owned, and what the catalog does not know stay out.
    assert rows(wide.select("user_id", "item_id", "recommend", "items_count", "playtime_forever")) == [
        ("u1", 1, 1, 3, 5), ("u1", 2, 0, 3, 4), ("u2", 3, 0, 2, 1)]


def test_genre_leaders(shop):
    catalog, libraries, _ = shop
    leaders = etl.genre_leaders(etl.genre_hours(libraries, catalog))
    # Rpg and RPG are one genre, a repeated genre counts once, a tie goes to the smaller user.
    assert rows(leaders.select("genre", "user_id", "hours")) == [
        ("Action", "u2", 1), ("Indie", "u2", 9), ("Rpg", "u1", 9)]
    assert rows(views.genre_leader(libraries, catalog, "rPG")) == [("Rpg", "u1", 2010, 9)]
    assert views.genre_leader(libraries, catalog, "none").count() == 0


def test_developer_names_match_within_others(shop):
    catalog = shop[0]
    years = views.developer_years(catalog, "ACME")
    assert rows(years.select("release_date", "items", "free_text")) == [(2010, 2, "50.0%")]
    exact = views.developer_years(catalog, "acme", match="exact")
    assert rows(exact.select("release_date", "items", "free_text")) == [(2010, 1, "0%")]
    # Part of a name alone is no developer.
    assert views.developer_years(catalog, "Acm").count() == 0


def test_developer_sentiment(shop):
    catalog, _, reviews = shop
    assert rows(views.developer_sentiment(catalog, reviews, "acme").select("negative", "positive")) == [(2, 2)]
    exact = views.developer_sentiment(catalog, reviews, "acme", match="exact")
    assert exact.first().negative_text == "Negative = 1"
    assert views.developer_sentiment(catalog, reviews, "nobody").count() == 0


def test_user_summary(shop):
    catalog, libraries, reviews = shop
    got = {r.user_id: r for r in views.user_summaries(libraries, catalog, reviews).collect()}
    assert (got["u1"].spent, got["u1"].recommend_percent, got["u1"].items_count) == (10.0, 66.67, 3)
    assert (got["u2"].spent, got["u2"].items_count) == (15.25, 2)
    assert (got["u3"].spent, got["u3"].recommend_percent) == (0.0, None)
    assert "u4" not in got
    one = views.user_summary(libraries, catalog, reviews, "u2").first()
    assert (one.spent_text, one.recommend_text) == ("15.25 USD", "50.0%")
    assert views.user_summary(libraries, catalog, reviews, "nobody").count() == 0


def test_no_positive_review_is_a_share_of_zero(shop, spark):
    catalog, libraries, _ = shop
    reviews = spark.createDataFrame([("u1", 1, False, 0)], schemas.REVIEWS)
    assert views.user_summary(libraries, catalog, reviews, "u1").first().recommend_text == "0.0%"


def test_best_developers(shop):
    catalog, _, reviews = shop
    best = views.best_developers_of_year(catalog, reviews, 2010)
    assert rows(best) == [(1, "Acme", 5), (2, "Acme Games", 0)]
    assert views.best_developers_of_year(catalog, reviews, 1900).count() == 0
    assert views.best_developers_of_year(catalog, reviews, 2012).count() == 0


def test_lookup(shop, spark):
    asked = spark.createDataFrame([("Acme",), ("Acm",)], "developer string")
    assert rows(joins.lookup_exists(asked, shop[0], "developer")) == [("Acm", False), ("Acme", True)]


def test_reports_at_both_grains(shop):
    catalog, libraries, reviews = shop
    wide = etl.build_interactions(reviews, libraries, catalog)
    doubled = wide.union(wide)
    assert rows(reports.counts_by_year(doubled)) == [(2010, 4), (2011, 2)]
    assert rows(reports.counts_by_year(doubled, grain="item")) == [(2010, 2), (2011, 1)]
    assert rows(reports.genre_counts(doubled, grain="item")) == [
        ("Action", 1), ("Indie", 1), ("RPG", 2), ("Rpg", 1)]


def test_a_developer_without_reviews_has_none_of_either_kind(spark):
    catalog = spark.createDataFrame([(1, "Acme"), (2, "Other")], "id bigint, developer string")
    reviews = spark.createDataFrame([("u", 2, True, 2)], schemas.REVIEWS)
    assert {tuple(r) for r in views.developer_sentiments(catalog, reviews).collect()} == {
        ("Acme", 0, 0), ("Other", 0, 1)}
    acme = views.developer_sentiment(catalog, reviews, "acme").collect()
    assert [(r.developer, r.negative, r.positive) for r in acme] == [("Acme", 0, 0)]
    assert views.developer_sentiment(catalog, reviews, "nobody").collect() == []


def test_rows_are_dropped_for_the_first_rule_that_fits(spark):
    schema = "id string, url string, title string, developer string, publisher string, genres array<string>, tags array<string>, price string, release_date string"
    good = ["t", "dev", None, ["A"], None, "1.5", "2016"]
    rows = [
        ("1", "b", *good), ("1", "a", *good), ("1", "c", *good), (None, "d", *good), ("x", "e", *good), (None,) * 9,
        ("2", "f", "t", "dev", None, None, None, "1.5", "2016"), ("3", "g", "t", "dev", None, ["A"], None, None, "2016"),
        ("4", "h", "t", "dev", None, ["A"], None, "1.5", "TBA"), ("5", "i", "t", None, None, ["A"], None, "1.5", "2016"),
        ("6", "j", "t", None, None, None, None, None, None),
    ]
    raw = spark.createDataFrame(rows, schema)
    found = {r.reason: r.n for r in reports.dropped_rows(raw, ["url"]).collect()}
    assert found == {"kept": 1, "repeated id": 2, "no id": 2, "empty": 1, "no genres": 2, "no price": 1, "no release_date": 1, "no developer": 1}
    assert found["kept"] == etl.clean_catalog(raw, [F.asc("url")]).count() and sum(found.values()) == raw.count()


def test_quality_report_scans_once(spark, capsys):
    raw = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    reports.data_quality(raw, "o_orderkey", ["o_orderstatus"], {"o_orderpriority": "^1"}).explain("formatted")
    assert capsys.readouterr().out.count("Scan parquet") == 2  # once in the tree, once in its details
