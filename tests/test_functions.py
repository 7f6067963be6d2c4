import pytest
from pyspark.sql import functions as F

from shelfwise import functions as fn


def one(spark, value, build, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(build(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("text, year", [
    ("1998-11-08", 1998), ("Coming-soon", None), ("Soon..", None), ("Coming Soon", None),
    ("TBA", None), ("Beta now", None), ("15.01.2018", 2018), ("2017.05", None), ("Jan 2017", 2017),
    ("2018 Q1", 2018), ("Q1 2018", 2018), ("2018 Q2", None), ("14 July", None),
    ("Not out yet ever", 2017), ("2016", 2016), ("", None), (None, None),
])
def test_release_year(spark, text, year):
    assert one(spark, text, fn.parse_release_year) == year


def test_release_year_of_long_text_is_a_parameter(spark):
    assert one(spark, "Not out yet ever", lambda c: fn.parse_release_year(c, 2020)) == 2020


@pytest.mark.parametrize("price, genres, tags, expected", [
    ("4.994", ["Action"], None, 4.99),
    (None, ["Free to Play", "Indie"], None, 0.0),
    (None, ["Indie"], ["Free to Play"], 0.0),
    (None, ["Free"], ["Indie"], None),
    (None, ["Indie"], None, None),
    ("Starting at $499.00", ["RPG"], None, 499.0),
    ("Starting at $449.00", ["RPG"], None, 449.0),
    ("Free Demo", ["RPG"], None, 0.0), ("Play", ["RPG"], None, 0.0),
    ("Install Now", ["RPG"], None, 0.0), ("Starting at $9.00", ["RPG"], None, 0.0),
    ("3d", ["RPG"], None, 0.0), ("NaN", ["RPG"], None, 0.0),
])
def test_price(spark, price, genres, tags, expected):
    df = spark.createDataFrame([(price, genres, tags)], "p string, g array<string>, t array<string>")
    assert df.select(fn.parse_price(F.col("p"), F.col("g"), F.col("t"))).first()[0] == expected


@pytest.mark.parametrize("text", [
    "3d realms", "they're", "bOX-art (uk) ltd.", "東京games", "ßeta straße", "a1b2c3", "É à\tlA\nx", "",
    "o'neill & sons, inc.", "ΑΣ σας", "x ﷐y",
])
def test_title_case_is_that_of_python(spark, text):
    assert one(spark, text, fn.title_case) == text.title()


@pytest.mark.parametrize("text", ["free To Play", "RPG", "", "ßa", "éA"])
def test_capitalize_is_that_of_python(spark, text):
    assert one(spark, text, fn.capitalize) == text.capitalize()


def test_trimming_removes_every_kind_of_white_space(spark):
    text = "\t\xa0 ab \t\x1f\n"
    assert one(spark, text, fn.trim_right) == text.rstrip()
    assert one(spark, text, fn.trim_left) == text.lstrip()


@pytest.mark.parametrize("text, n", [("", 0), ("  ", 0), ("a", 1), (" a  b\tc ", 3)])
def test_word_count(spark, text, n):
    assert one(spark, text, fn.word_count) == n


def test_split_part_out_of_range_is_null(spark):
    assert one(spark, "15.01.2018", lambda c: fn.split_part(c, ".", 2)) == "2018"
    assert one(spark, "2018", lambda c: fn.split_part(c, ".", 2)) is None


@pytest.mark.parametrize("value, expected", [
    (-1.0, 0), (-0.51, 0), (-0.5, 1), (0.0, 1), (0.5, 1), (0.51, 2), (1.0, 2),
])
def test_class_of_a_score(spark, value, expected):
    assert one(spark, value, lambda c: fn.round_half_even(c) + 1, "v double") == expected


@pytest.mark.parametrize("part, total, text", [(1, 3, "33.33%"), (3, 3, "100.0%"), (0, 3, "0%")])
def test_percent_text(spark, part, total, text):
    df = spark.createDataFrame([(part, total)], "a bigint, b bigint")
    assert df.select(fn.percent_text(F.col("a"), F.col("b"))).first()[0] == text


def test_nested_ids_keep_places_of_bad_ids(spark):
    text = '[{"item_id": "10", "item_name": "a ] } b"}, {"item_id": "x"}, {"item_id": "30"}]'
    assert one(spark, text, fn.parse_nested_ids) == [10, None, 30]


def test_explode_keeps_empty_and_missing_lists(spark):
    df = spark.createDataFrame([("a", [1, 2]), ("b", []), ("c", None)], "k string, v array<int>")
    rows = sorted(map(tuple, fn.explode_nested(df, "v", "x").collect()), key=str)
    assert rows == [("a", 1), ("a", 2), ("b", None), ("c", None)]


def test_year_map_is_entered_in_order(spark):
    df = spark.createDataFrame([([(2011, 5), (2009, 7)],)], "e array<struct<year: int, hours: int>>")
    keys = df.select(F.map_keys(fn.build_year_map(F.col("e")))).first()[0]
    assert keys == ["Year 2009", "Year 2011"]


def test_one_hot(spark):
    df = spark.createDataFrame([(["A", "B"],), (None,)], "g array<string>")
    rows = fn.one_hot_array(df, "g", ["A", "C"], "is_").select("is_A", "is_C").collect()
    assert [tuple(r) for r in rows] == [(1, 0), (0, 0)]
