import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import aggregates, quality, ranking
from shelfwise.operators.recommender import dense_ids


def values(spark, numbers):
    return spark.createDataFrame([(float(n),) for n in numbers], "v double")


def test_box_stats_interpolate(spark):
    box = aggregates.box_stats(values(spark, [1, 2, 3, 10]), "v").first()
    assert (box.q1, box.median, box.q3) == (1.75, 2.5, 4.75)
    assert (box.whisker_low, box.whisker_high, box.outliers, box.n) == (1, 3, 1, 4)


@pytest.mark.parametrize("numbers", [[5], [5, 5], [1, 2], list(range(101)), [0.01] * 50 + [1e6], [-1.5, 0, 3, 3, 8]])
def test_exact_quartiles_are_those_of_numpy(spark, numbers):
    box = aggregates.box_stats(values(spark, numbers), "v").first()
    assert np.allclose([box.q1, box.median, box.q3], np.percentile(numbers, [25, 50, 75]))


def test_quartiles_of_many_values(spark):
    numbers = np.random.default_rng(1).lognormal(3, 2, 5000).round(2)
    box = aggregates.box_stats(values(spark, numbers), "v").first()
    assert np.allclose([box.q1, box.median, box.q3], np.percentile(numbers, [25, 50, 75]))


def test_values_at_ranks_are_those_of_sorting(spark):
    rng = np.random.default_rng(4)
    numbers = np.concatenate([rng.normal(0, 1, 300) * 10.0 ** rng.integers(-300, 300, 300), [0.0, -0.0, 5e-324, -5e-324, np.inf, -np.inf]])
    times = rng.integers(1, 4, len(numbers))
    counted = spark.createDataFrame(list(zip(numbers.tolist(), times.tolist())), "v double, n bigint").repartition(5)
    every = np.sort(np.repeat(numbers, times))
    ranks = [0, 1, len(every) // 2, len(every) // 2, len(every) - 2, len(every) - 1, *rng.integers(0, len(every), 20).tolist()]
    assert aggregates.values_at_ranks(counted, ranks) == [every[r] for r in ranks]


def test_no_value_has_no_quartiles(spark):
    box = aggregates.box_stats(spark.createDataFrame([(None,)], "v double"), "v").first()
    assert box.q1 is None and box.median is None and box.n is None


def test_quartiles_sort_nothing(spark, capsys):
    aggregates.box_stats(values(spark, range(1000)), "v").explain()
    assert not any(word in capsys.readouterr().out for word in ("Sort ", "Window"))


def test_box_stats_weigh_repeated_values(spark):
    numbers = [1.0] * 5 + [2.0] * 7 + [9.0] * 2
    box = aggregates.box_stats(values(spark, numbers), "v").first()
    assert [box.q1, box.median, box.q3] == list(np.percentile(numbers, [25, 50, 75]))
    near = aggregates.box_stats(values(spark, numbers), "v", approximate=True).first()
    assert near.median == 2.0


@pytest.mark.parametrize("numbers", [list(range(100)), [0, 0, 0, 1, 7, 30], [5, 5, 5], [-3, 2.5]])
def test_histogram_is_that_of_numpy(spark, numbers):
    counts, edges = np.histogram(numbers, bins=30)
    got = aggregates.histogram(values(spark, numbers), "v").orderBy("bin").collect()
    assert [r.n for r in got] == counts.tolist()
    assert np.allclose([r.lower for r in got], edges[:-1])
    assert np.allclose([r.upper for r in got], edges[1:])


def test_histogram_leaves_missing_values_out(spark):
    df = spark.createDataFrame([(1.0,), (None,), (2.0,)], "v double")
    assert sum(r.n for r in aggregates.histogram(df, "v").collect()) == 2


def test_dedup_keeps_the_first_of_a_hot_key(spark):
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("key"), (-F.col("id")).alias("order"))
    got = ranking.dedup_keep_first(df, "key", [F.asc("order")])
    assert got.count() == df.select("key").distinct().count()
    assert got.filter("key = 0").first().order == -19999


def test_top_per_group_bounds_rows_before_the_shuffle(spark, capsys):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), "id")
    ranking.top_per_group(df, ["g"], [F.desc("id")], 3).explain()
    plan = capsys.readouterr().out
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_ranks_and_ties(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5), ("d", 1)], "k string, n int")
    got = ranking.rank_top(df, "n", "k", 3).collect()
    assert [(r.place, r.k) for r in got] == [(1, "c"), (2, "a"), (3, "b")]


def test_quality(spark):
    df = spark.createDataFrame([(1, None, None), (1, "x", None), (None, "y", None)], "a int, b string, c string")
    assert {r[0]: r[1] for r in quality.null_counts(df).collect()} == {"a": 1, "b": 1, "c": 3}
    assert quality.drop_empty_columns(df).columns == ["a", "b"]
    assert {(r.column, r.type, r.non_null) for r in quality.column_profile(df).collect()} == {
        ("a", "int", 2), ("b", "string", 2), ("c", "string", 0)}
    assert [tuple(r) for r in quality.duplicate_key_report(df, "a").collect()] == [(True, 1)]
    assert {r[0]: r[1] for r in quality.distinct_counts(df, ["a", "b"]).collect()} == {"a": 1, "b": 2}


def test_element_counts_count_a_row_once(spark):
    df = spark.createDataFrame([(["A", "A", "B"],), (["A"],), (None,)], "g array<string>")
    got = {r[0]: r[1] for r in aggregates.count_by_element(df, "g", "genre").collect()}
    assert got == {"A": 2, "B": 1}


def test_row_sum_takes_missing_as_zero(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    assert [r[0] for r in df.select(aggregates.row_sum("a", "b")).collect()] == [1, 5]


def test_dense_ids_have_no_gaps(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    ids = [r.first_id for r in dense_ids(keys, "key").collect()]
    assert sorted(ids) == list(range(5000))
    again = dense_ids(keys.repartition(7), "key")
    assert again.join(dense_ids(keys, "key"), ["key", "first_id"]).count() == 5000


def test_dense_ids_reserve_ranges(spark):
    keys = spark.createDataFrame([("a", 3), ("b", 1), ("c", 2)], "key string, size int")
    taken = [i for r in dense_ids(keys, "key", weight="size").collect()
             for i in range(r.first_id, r.first_id + r.size)]
    assert sorted(taken) == list(range(6))
