"""Plans: what is pushed down, what is broadcast, what is split."""

import os

import pytest
from pyspark.sql import functions as F

from shelfwise.checks import QUERIES
from shelfwise.checks.tables import Tables
from shelfwise.operators import joins
from shelfwise.plans import etl, views

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Fitting a model runs jobs while the query is built; its plans are looked at elsewhere.
FITTED = {"fit_recommender", "predict_holdout", "cv_by_rank", "grid_search", "model_roundtrip",
          "recommend_top5", "user_recommendations"}


@pytest.fixture
def plan_of(capsys):
    def explain(df):
        capsys.readouterr()
        df.explain("formatted")
        return capsys.readouterr().out

    return explain


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in FITTED])
def test_no_row_python_and_no_cross_join(spark, plan_of, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


def test_year_filter_and_columns_reach_the_scan(spark, plan_of, tmp_path):
    t = Tables(spark, FOLDER)
    t.catalog().write.parquet(str(tmp_path / "catalog"))
    t.reviews().write.parquet(str(tmp_path / "reviews"))
    catalog, reviews = (spark.read.parquet(str(tmp_path / n)) for n in ("catalog", "reviews"))
    plan = plan_of(views.best_developers_of_year(catalog, reviews, 1998))
    assert "EqualTo(release_date,1998)" in plan
    assert "ReadSchema: struct<item_id:bigint,recommend:boolean,sentiment_analysis:int>" in plan
    assert "ReadSchema: struct<id:bigint,developer:string,release_date:int>" in plan
    assert "TakeOrderedAndProject" in plan


def test_reviews_are_counted_per_item_before_they_meet_the_catalog(spark, plan_of):
    t = Tables(spark, FOLDER)
    plan = plan_of(views.developer_sentiments(t.catalog(), t.reviews()))
    tree = plan.split("\n\n")[0]
    # Read from the top: totals per developer, the join with the catalog, counts per item.
    order = [tree.index(x) for x in ("HashAggregate", "Join", "HashAggregate")]
    assert order[0] < order[1] and tree.rindex("HashAggregate") > order[1]


def test_user_filter_reaches_both_scans(spark, plan_of, tmp_path):
    t = Tables(spark, FOLDER)
    t.reviews().write.parquet(str(tmp_path / "reviews"))
    t.libraries().write.parquet(str(tmp_path / "libraries"))
    reviews, libraries = (spark.read.parquet(str(tmp_path / n)) for n in ("reviews", "libraries"))
    plan = plan_of(views.user_summary(libraries, t.catalog(), reviews, "42"))
    assert plan.count("EqualTo(user_id,42)") >= 3


def test_a_hot_item_is_split_when_the_catalog_is_too_large_to_broadcast(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        catalog = spark.range(200).select("id", F.concat(F.lit("d"), F.col("id") % 7).alias("developer"))
        rows = spark.range(0, 60000, 1, 16).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 200).alias("item_id"),
            F.xxhash64("id").alias("payload"),
        )
        joined = joins.join_catalog(rows, catalog, ["developer"])
        joined.collect()
        assert "SortMergeJoin(skew=true)" in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 60000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_leaders_are_cut_to_one_per_genre_before_the_shuffle(spark, plan_of):
    t = Tables(spark, FOLDER)
    tree = plan_of(etl.genre_leaders(etl.genre_hours(t.libraries(), t.catalog()))).split("\n\n")[0]
    assert tree.count("WindowGroupLimit") == 2


def test_no_row_per_genre_is_shuffled_before_leaders_are_cut(spark, plan_of):
    t = Tables(spark, FOLDER)
    tree = plan_of(etl.genre_leaders(etl.genre_hours(t.libraries(), t.catalog()))).split("\n\n")[0]
    above = tree[:tree.index("Generate")]  # what follows the explosion of the genres
    assert above.count("Exchange") == 1 and above.index("WindowGroupLimit") < above.index("Exchange") < above.rindex("WindowGroupLimit")


def test_owned_items_are_shuffled_once_for_copies_and_join(spark, plan_of):
    library = spark.createDataFrame(
        [("u", [(1, "one", 5, 0), (1, "one", 5, 0)])],
        "user_id string, items array<struct<item_id:bigint,item_name:string,playtime_forever:bigint,playtime_2weeks:bigint>>",
    ).withColumn("items_count", F.lit(2).cast("bigint"))
    reviews = spark.createDataFrame([("u", 1, True, 2)], "user_id string, item_id bigint, recommend boolean, sentiment_analysis int")
    catalog = spark.createDataFrame(
        [(1, ["a"], 1999, 1.0, "d")], "id bigint, genres array<string>, release_date int, price double, developer string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = etl.build_interactions(reviews, library, catalog)
        plan = plan_of(wide)
        assert plan.count("hashpartitioning(user_id#") > 0 and "item_name#" not in "".join(
            line.split("hashpartitioning")[1] for line in plan.splitlines() if "hashpartitioning" in line)
        assert [(r.user_id, r.item_id, r.items_count) for r in wide.collect()] == [("u", 1, 2)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
