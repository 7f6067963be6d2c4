"""The way from raw files to answers, as the README shows it."""

import gzip
import json

import pytest

from shelfwise import schemas, sources
from shelfwise.operators.recommender import build_ratings, fit_recommender
from shelfwise.plans import etl, reports, views

USERS, ITEMS = 12, 20


@pytest.fixture(scope="module")
def feeds(tmp_path_factory):
    folder = tmp_path_factory.mktemp("feeds")
    items = [
        {"id": str(i), "title": f"Item {i}", "developer": f"studio {i % 4}", "genres": ["Indie", f"G{i % 3}"],
         "price": None if i % 5 == 0 else i + 0.99, "tags": ["Free to Play"], "release_date": f"{2010 + i % 3}-05-01"}
        for i in range(ITEMS)
    ]
    with gzip.open(folder / "catalog.json.gz", "wt") as out:
        out.write("\n".join(map(json.dumps, [{}, *items, items[0]])))
    with open(folder / "reviews.txt", "w") as out:
        for u in range(USERS):
            reviews = [
                {"funny": "", "posted": "Posted", "last_edited": "", "item_id": str(i), "helpful": "",
                 "recommend": (u + i) % 3 > 0, "review": ["It's great!", "bad", "so-so \"hm\""][(u + i) % 3]}
                for i in range(u % 3, ITEMS, 3)
            ]
            out.write(repr({"user_id": f"u{u}", "user_url": None, "reviews": reviews}) + "\n")
        out.write("{'user_id': broken\n")
    (folder / "lexicon.txt").write_text("great\t3.1\t0.7\t[]\nbad\t-2.5\t0.7\t[]\n")
    return folder


def test_raw_files_to_answers(spark, feeds, tmp_path):
    owned = [(f"u{u}", ITEMS, None, None, [(str(i), f"Item {i}", 10 * u + i, 0) for i in range(u % 3, ITEMS, 3)])
             for u in range(USERS)]
    sources.write_parquet(spark.createDataFrame(owned, schemas.LIBRARIES_RAW), str(tmp_path / "libraries"))

    catalog = etl.clean_catalog(
        sources.scan_json_lines(spark, str(feeds / "catalog.json.gz"), schemas.CATALOG_RAW))
    lines = sources.scan_literal_lines(spark, str(feeds / "reviews.txt"), schemas.REVIEWS_RAW)
    lexicon = sources.scan_lexicon(spark, str(feeds / "lexicon.txt"))
    reviews = etl.clean_reviews(lines.filter("_corrupt_record is null").drop("_corrupt_record"), lexicon)
    libraries = etl.slim_libraries(sources.scan_parquet(spark, str(tmp_path / "libraries")))

    assert catalog.count() == ITEMS
    classes = {tuple(r) for r in reviews.selectExpr(
        "(cast(substr(user_id, 2) as int) + item_id) % 3", "recommend", "sentiment_analysis").distinct().collect()}
    assert classes == {(0, False, 2), (1, True, 0), (2, True, 1)}

    years = views.developer_years(catalog, "Studio 1").collect()
    assert sum(r["items"] for r in years) == 5 and all(r.free_text.endswith("%") for r in years)
    assert views.user_summary(libraries, catalog, reviews, "u3").first().items_count == ITEMS
    assert {r.user_id for r in views.genre_leader(libraries, catalog, "indie").collect()} == {"u10"}
    assert [r.place for r in views.best_developers_of_year(catalog, reviews, 2011).collect()] == [1, 2, 3]
    assert views.developer_sentiment(catalog, reviews, "Studio 1").count() == 1

    wide = etl.build_interactions(reviews, libraries, catalog)
    assert wide.count() == sum(len(range(u % 3, ITEMS, 3)) for u in range(USERS))
    assert reports.top_playtime(wide).count() == 5
    model = fit_recommender(build_ratings(wide), iterations=5)
    best = views.user_recommendations(model, wide, "u1").collect()
    mine = {r.item_id for r in wide.filter("user_id = 'u1'").collect()}
    assert len(best) == 5 and not mine & {r.item_id for r in best}
    assert views.user_recommendations(model, wide, "nobody").count() == 0
