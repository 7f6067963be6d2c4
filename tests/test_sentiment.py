import math
import re

import pytest
from pyspark.sql import functions as F

from shelfwise import schemas
from shelfwise.operators.sentiment import score_texts, sentiment_class

WORDS = [("good", 1.9), ("great", 3.1), ("bad", -2.5), ("kind", 2.4), (":)", 2.0), ("Love", 3.2)]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(WORDS, schemas.LEXICON)


def compound(spark, lexicon, text):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return score_texts(df, "text", lexicon).first().compound


def of(total):
    return round(total / math.sqrt(total * total + 15), 4)


@pytest.mark.parametrize("text, expected", [
    ("this game is great", 2), ("not good", 1), ("very bad bad", 0), ("a game", 1), (None, 1), ("", 1),
])
def test_classes(spark, lexicon, text, expected):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert sentiment_class(df, "text", lexicon).first().sentiment_analysis == expected


@pytest.mark.parametrize("text, total", [
    ("good", 1.9),
    ("not good", 1.9 * -0.74),
    ("very good", 1.9 + 0.293),
    ("very bad", -2.5 - 0.293),
    ("slightly good", 1.9 - 0.293),
    ("really is good", 1.9 + 0.293 * 0.95),
    ("really is the good", 1.9 + 0.293 * 0.9),
    ("was not very good", (1.9 + 0.293) * -0.74),
    ("never so good", 1.9 * 1.5 + 0.293 * 1.5),
    ("it isn't good", 1.9 * -0.74),
    ("GOOD game", 1.9 + 0.733),
    ("GOOD", 1.9),
    ("VERY good game", 1.9 + 0.293 + 0.733),
    ("good but bad", 1.9 * 0.5 - 2.5 * 1.5),
    ("the least good", 1.9 * -0.74),
    ("at least good", 1.9),
    ("kind of good", 1.9 + 0),
    ("kind people", 2.4),
    ("good!!", 1.9 + 2 * 0.292),
    ("bad!!!!!!", -2.5 - 4 * 0.292),
    ("good??", 1.9 + 2 * 0.18),
    ("good????", 1.9 + 0.96),
    ("game :) (good)", 3.9),
    ("I love it", 3.2),
])
def test_rules(spark, lexicon, text, total):
    assert compound(spark, lexicon, text) == pytest.approx(of(total), abs=1e-4)


@pytest.mark.parametrize("text, total", [
    ("my friend is the bomb", 3.0),
    ("it is always a bad ass", 1.5 + 1.5),
    ("not that it was really bad ass", 1.5 + 1.5),
    ("the game is good yeah right", 0.5 + 1.9),
    ("they say so yeah right good", -2.0),
    ("that will not cut the mustard", 2.0 + 0.5 * -0.74),
    ("a truly great kiss of death", 3.1 - 2.9),
    ("what a truly sad kiss of death", -1.5),
    ("they lived from hand to mouth good", -2.0 - 2.0),
    ("it is not The bomb", 0.5 * -0.74),
    ("is the bomb", 0.5),
    ("great was it the bomb", 3.1 + 0.5),
    ("great is the bomb", 3.1 + 0.5),
    ("it is sort of good", 1.9 - 0.293),
    ("it is just enough bad", -2.5 - 0.293),
    ("it was sort of very good", 1.9 + 0.293 - 0.293),
])
def test_idioms(spark, text, total):
    words = [*WORDS, ("the", 0.5), ("ass", -2.5), ("cut", -1.1), ("death", -2.9), ("mouth", 0.1)]
    lexicon = spark.createDataFrame(words, schemas.LEXICON)
    assert compound(spark, lexicon, text) == pytest.approx(of(total), abs=1e-4)


def test_a_modifier_of_the_lexicon_does_not_modify(spark):
    lexicon = spark.createDataFrame([*WORDS, ("not", -0.5)], schemas.LEXICON)
    assert compound(spark, lexicon, "not good") == pytest.approx(of(1.9 - 0.5), abs=1e-4)


def test_equal_rows_all_stay(spark, lexicon):
    rows = [("u", 1, "great great")] * 500 + [("u", 1, "bad bad")] * 3 + [("u", 1, None)] * 2
    df = spark.createDataFrame(rows, "user_id string, item_id int, text string").repartition(5)
    counts = sentiment_class(df, "text", lexicon).groupBy("sentiment_analysis").count().collect()
    assert {r[0]: r[1] for r in counts} == {2: 500, 0: 3, 1: 2}


def test_whole_texts_count(spark, lexicon):
    text = "word " * 30000 + "great great"
    assert compound(spark, lexicon, text) == pytest.approx(of(6.2), abs=1e-4)


def test_scores_do_not_depend_on_the_join(spark, lexicon):
    rows = [(i, t) for i, t in enumerate(["very good", "not bad", "kind of", None, "bad but great"] * 20)]
    df = spark.createDataFrame(rows, "id int, text string")
    small = score_texts(df, "text", lexicon).collect()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        large = score_texts(df, "text", lexicon).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert sorted(small) == sorted(large)


def test_one_shuffle_of_sums(spark, lexicon, capsys):
    df = spark.range(10).select("id", F.lit("good game").alias("text"))
    score_texts(df, "text", lexicon).explain()
    plan = capsys.readouterr().out
    assert "BatchEvalPython" not in plan and "Window" not in plan
    assert plan.count("Exchange hashpartitioning(_keep") == 1


def test_the_loop_over_tokens_is_small_enough_to_be_compiled(spark, capsys):
    lexicon = spark.sql("SELECT * FROM VALUES ('good', 1.9D), ('not', -0.2D) AS l(token, valence)")  # small enough to be broadcast
    df = spark.createDataFrame([("a", 1, True, "good game")], "user_id string, item_id bigint, recommend boolean, text string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sentiment_class(df, "text", lexicon).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 7800


def test_words_in_capitals_and_bare_marks(spark, lexicon):
    rows = [(0, "--- VERY good"), (1, "very GOOD"), (2, "VERY GOOD"), (3, ":) good !!"), (4, "(good) ..."), (5, "")]
    scores = score_texts(spark.createDataFrame(rows, "id int, text string"), "text", lexicon).collect()
    loud = [1.9 + 0.293 + 0.733, 1.9 + 0.733 + 0.293, 1.9 + 0.293, 2.0 + 1.9 + 2 * 0.292, 1.9, 0.0]
    assert {r.id: r.compound for r in scores} == pytest.approx({i: of(x) for i, x in enumerate(loud)}, abs=1e-4)
