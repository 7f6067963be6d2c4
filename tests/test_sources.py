import pytest
from pyspark.sql import functions as F

from shelfwise import schemas, sources
from shelfwise.sources.readers import literal_to_json


def record(review):
    """A raw review record holding one text."""
    return {"user_id": "u1", "user_url": None, "reviews": [{
        "funny": "", "posted": "Posted.", "last_edited": "", "item_id": "10", "helpful": "none",
        "recommend": True, "review": review}]}


@pytest.mark.parametrize("text", [
    "plain", "it's", 'a "quote"', "both ' and \"", "line\nbreak\ttab", "no\xa0break", "back\\slash",
    "\\\\xa0 stays", "True", "': True, 'x': None}", "'recommend': False}", "emoji 🎮 and ★", "", "\x07\x1b",
    "ends with \\", "x" * 20000 + "'", "tag \U000e0001 of \U000e0001\U000f0000 and \\U000e0001", "\xad\U000e0001'",
])
def test_literal_lines_keep_every_text(spark, text):
    df = spark.createDataFrame([(repr(record(text)),)], "value string")
    row = sources.parse_literal_records(df, schemas.REVIEWS_RAW).first()
    assert row._corrupt_record is None
    assert row.reviews[0].review == text
    assert row.reviews[0].recommend is True
    assert row.user_id == "u1"


def test_unreadable_lines_are_kept_and_marked(spark, tmp_path):
    (tmp_path / "feed.json").write_text(repr(record("ok")) + "\n{'user_id': 'u2', 'reviews': [\n")
    df = sources.scan_literal_lines(spark, str(tmp_path / "feed.json"), schemas.REVIEWS_RAW)
    assert df.filter(F.col("_corrupt_record").isNull()).count() == 1
    assert df.filter(F.col("_corrupt_record").isNotNull()).count() == 1


def test_constants_outside_texts_only(spark):
    df = spark.createDataFrame([("{'a': True, 'b': [None, False, 'None'], 'c': -1.5}",)], "v string")
    assert df.select(literal_to_json(F.col("v"))).first()[0] == (
        "{'a': true, 'b': [null, false, 'None'], 'c': -1.5}")


def libraries(spark):
    return spark.createDataFrame([
        ("u1", 2, [(1, 'A "quoted", name', 5, 0), (2, "B\nnext [x] }", 7, 1)]),
        ("u2", 0, []),
        ("u1", 1, [(3, "…", 1, 0)]),
    ], schemas.LIBRARIES)


def test_csv_round_trip_with_nested_column(spark):
    path = sources.scratch_path(spark, "csv")
    sources.write_csv_gz(libraries(spark), path)
    back = sources.scan_csv_gz(spark, path, schemas.LIBRARIES_CSV)
    items = F.from_json("items", schemas.LIBRARIES["items"].dataType).alias("items")
    rows = back.select("user_id", "items_count", items).collect()
    assert sorted(rows, key=str) == sorted(libraries(spark).collect(), key=str)
    mine = sources.scan_csv_gz(spark, path, schemas.LIBRARIES_CSV, user_id="u1")
    assert mine.count() == 2


def test_json_and_parquet_round_trip(spark):
    for write, read in (
        (sources.write_json_gz, lambda p: sources.scan_json_lines(spark, p, schemas.LIBRARIES)),
        (sources.write_parquet, lambda p: sources.scan_parquet(spark, p)),
    ):
        path = sources.scratch_path(spark, "table")
        write(libraries(spark), path)
        assert sorted(read(path).collect(), key=str) == sorted(libraries(spark).collect(), key=str)


def test_partitioned_parquet_prunes(spark, capsys):
    path = sources.scratch_path(spark, "years")
    df = spark.createDataFrame([(1, 2010), (2, 2011)], "id int, year int")
    sources.write_parquet(df, path, ["year"])
    spark.read.parquet(path).filter(F.col("year") == 2011).explain()
    assert "PartitionFilters: [isnotnull(year" in capsys.readouterr().out


def test_lexicon(spark, tmp_path):
    (tmp_path / "lexicon.txt").write_text("good\t1.9\t0.9\t[2, 1]\n:)\t2.0\t1.1\t[1]\nbroken\n")
    rows = sources.scan_lexicon(spark, str(tmp_path / "lexicon.txt")).collect()
    assert sorted(map(tuple, rows)) == [(":)", 2.0), ("good", 1.9)]


def test_scratch_lies_below_the_shared_folder(spark):
    assert sources.scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_files_that_can_be_split_are_not_spread(spark, tmp_path):
    path = str(tmp_path / "plain")
    spark.range(10).write.json(path)
    rows = sources.scan_json_lines(spark, path, "id bigint")
    assert "REBALANCE" not in rows._jdf.queryExecution().executedPlan().toString()
    spark.range(10).write.option("compression", "gzip").json(f"{path}-gz")
    rows = sources.scan_json_lines(spark, f"{path}-gz/*.gz", "id bigint")
    assert "REBALANCE" in rows._jdf.queryExecution().executedPlan().toString()


def test_a_gzip_feed_is_spread_after_the_scan(spark, tmp_path):
    path = str(tmp_path / "feed")
    rows = spark.range(2000).select(F.concat(F.lit("{'user_id': '"), F.sha2(F.col("id").cast("string"), 512), F.lit("', 'reviews': []}")).alias("value"))
    rows.coalesce(1).write.option("compression", "gzip").text(path)
    small = {"advisoryPartitionSizeInBytes": "4k", "coalescePartitions.minPartitionSize": "1k"}
    for name, size in small.items():
        spark.conf.set(f"spark.sql.adaptive.{name}", size)
    try:
        plan = sources.scan_literal_lines(spark, f"{path}/*.gz", schemas.REVIEWS_RAW)
        assert "REBALANCE_PARTITIONS" in plan._jdf.queryExecution().executedPlan().toString()
        assert plan.select("user_id").rdd.getNumPartitions() > 1
        assert plan.filter("user_id is not null").count() == 2000
    finally:
        for name in small:
            spark.conf.unset(f"spark.sql.adaptive.{name}")


def rows_scanned(df):
    """Rows that the scan of a one-table query gave, and the result."""
    rows = df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.head().metrics().apply("numOutputRows").value(), rows


def test_a_lookup_reads_few_row_groups(spark, tmp_path):
    """Of a table written for one-user questions, most row groups are skipped; of one written as it comes, none."""
    libraries = spark.range(60_000).select(
        F.md5((F.col("id") % 2_000).cast("string")).alias("user_id"), F.col("id").alias("item_id"), F.rand(3).alias("hours"))
    spark.conf.set("parquet.block.size", "65536")
    try:
        sources.write_parquet(libraries.repartition(4), str(tmp_path / "plain"))
        sources.write_parquet(libraries, str(tmp_path / "sorted"), lookup="user_id")
    finally:
        spark.conf.unset("parquet.block.size")
    user = libraries.first().user_id
    plain, sorted_ = (
        rows_scanned(sources.scan_parquet(spark, str(tmp_path / name)).filter(F.col("user_id") == user)) for name in ("plain", "sorted"))
    assert sorted(plain[1]) == sorted(sorted_[1]) and len(plain[1]) == 30
    assert sorted_[0] < 0.1 * plain[0]
    nobody = sources.scan_parquet(spark, str(tmp_path / "sorted")).filter(F.col("user_id") == "0" * 31 + "x")
    assert rows_scanned(nobody)[0] < 0.1 * 60_000
    assert sources.scan_parquet(spark, str(tmp_path / "sorted")).count() == 60_000
