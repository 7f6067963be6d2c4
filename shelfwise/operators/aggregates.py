"""Grouped measures and distributions.

All group by way of partial aggregates, so a hot key costs one row per task in the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import percent_text
from shelfwise.sources.scratch import stored_table

MONEY = "decimal(18,2)"
# Counters of a 16-bit digit.
DIGIT_VALUES = 1 << 16


def money_sum(c: Column | str) -> Column:
    """Sum of amounts with cents, independent of the order of addition."""
    column = F.col(c) if isinstance(c, str) else c
    return F.sum(column.cast(MONEY)).cast("double")


def free_share(catalog: DataFrame, *keys: str) -> DataFrame:
    """Items, free items and the free share (number and text) per group."""
    grouped = catalog.groupBy(*keys).agg(
        F.count("*").alias("items"), F.count_if(F.col("price") == 0).alias("free_items")
    )
    return grouped.select(
        *keys,
        "items",
        "free_items",
        F.round(F.col("free_items") / F.col("items") * 100, 2).alias("free_percent"),
        percent_text(F.col("free_items"), F.col("items")).alias("free_text"),
    )


def recommend_share(reviews: DataFrame, *keys: str) -> DataFrame:
    """Reviews, recommending reviews and their share in percent per group."""
    grouped = reviews.groupBy(*keys).agg(
        F.count("*").alias("reviews"), F.count_if(F.col("recommend")).alias("recommended")
    )
    share = F.round(F.try_divide(F.col("recommended"), F.col("reviews")) * 100, 2)
    return grouped.withColumn("recommend_percent", share)


def sum_by_group(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def first_value_per_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The value of the row that comes first in ``order`` within each key."""
    return df.groupBy(key).agg(F.min_by(value, order).alias(value))


def row_sum(*columns: str) -> Column:
    """Sum across columns of one row; a missing value counts as 0."""
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in columns[1:]),
               start=F.coalesce(F.col(columns[0]), F.lit(0)))


def count_by_element(df: DataFrame, column: str, alias: str, count: str = "n") -> DataFrame:
    """Rows per list element; a repeated element counts its row once."""
    elements = df.select(F.explode(F.array_distinct(column)).alias(alias))
    return elements.groupBy(alias).agg(F.count("*").alias(count))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, lower, upper, n) of ``bins`` equal-width bins, empty ones included.

    The largest value belongs to the last bin. The bounds are two scalars found in a pass of their
    own, so that the counting pass needs no join.
    """
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    spread = F.when(F.min("v") == F.max("v"), F.lit(0.5)).otherwise(F.lit(0.0))
    low = values.agg(F.min("v") - spread).scalar()
    high = values.agg(F.max("v") + spread).scalar()
    counted = (
        values.select(F.least(F.width_bucket("v", low, high, F.lit(bins)), F.lit(bins)).alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )
    all_bins = df.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin"))
    width = (high - low) / bins
    return all_bins.join(counted, "bin", "left").select(
        "bin",
        (low + (F.col("bin") - 1) * width).alias("lower"),
        (low + F.col("bin") * width).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def _sortable(v: np.ndarray) -> np.ndarray:
    """Doubles as unsigned 64-bit integers in the same order."""
    bits = (np.asarray(v, np.float64) + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.uint64) ^ np.uint64(1 << 63)


def _double(key: int) -> float:
    """The double that ``_sortable`` gives ``key``."""
    bits = np.array([key ^ (1 << 63)], np.uint64).view(np.int64)
    return float((bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.float64)[0])


def values_at_ranks(counted: DataFrame, ranks: Sequence[int]) -> list[float]:
    """The values at the given ranks, from 0, of the sorted rows that ``counted`` (v double, n) stands for.

    A rank is found 16 bits at a time, from the highest: a pass counts the next 16 bits of the values that share the bits found so
    far, ``DIGIT_VALUES`` counters a rank at most, and nothing is put in order but these. Four passes find any number of ranks.
    """
    found = [(0, rank) for rank in ranks]  # the bits so far, and the rank among the values that have them
    for shift in (48, 32, 16, 0):
        prefixes = sorted({bits for bits, _ in found})

        def count(batches: Iterator[pa.RecordBatch], shift: int = shift, prefixes: list[int] = prefixes) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(prefixes), DIGIT_VALUES), np.int64)
            for batch in batches:
                keys, n = _sortable(batch.column(0).to_numpy()), batch.column(1).to_numpy()
                digits = ((keys >> np.uint64(shift)) & np.uint64(DIGIT_VALUES - 1)).astype(np.int64)
                for i, prefix in enumerate(prefixes):
                    own = slice(None) if shift == 48 else (keys >> np.uint64(shift + 16)) == np.uint64(prefix)
                    sums[i] += np.bincount(digits[own], n[own], DIGIT_VALUES).astype(np.int64)
            at, digit = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array(digit, pa.int32()), pa.array(sums[at, digit])], names=["at", "digit", "n"])

        counters = np.zeros((len(prefixes), DIGIT_VALUES), np.int64)
        parts = counted.select("v", "n").mapInArrow(count, "at int, digit int, n bigint")
        for row in parts.groupBy("at", "digit").agg(F.sum("n").alias("n")).toLocalIterator():
            counters[row["at"], row["digit"]] = row["n"]
        upto = counters.cumsum(axis=1)
        after = []
        for bits, rank in found:
            i = prefixes.index(bits)
            digit = int(np.searchsorted(upto[i], rank, side="right"))
            after.append((bits << 16 | digit, rank - int(upto[i][digit] - counters[i][digit])))
        found = after
    return [_double(bits) for bits, _ in found]


def exact_quantiles(counted: DataFrame, shares: Sequence[float]) -> list[float | None]:
    """Interpolated quantiles of the rows that ``counted`` (v double, n) stands for; NULL if there are none."""
    total = counted.agg(F.sum("n")).first()[0]
    if not total:
        return [None] * len(shares)
    places = [share * (total - 1) for share in shares]
    at = values_at_ranks(counted, [r for p in places for r in (math.floor(p), math.ceil(p))])
    return [
        low if low == high else low + (high - low) * (p - math.floor(p))
        for p, low, high in zip(places, at[::2], at[1::2], strict=True)
    ]


def box_stats(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """One row of box-plot figures: quartiles, whiskers, number of values beyond them.

    Equal values are counted together first, and the counts stored, as several passes read them. ``approximate`` takes the
    quartiles from a sketch, which spares the passes that find the exact ones.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    counted = values.groupBy("v").agg(F.count("*").alias("n"))
    shares = [0.25, 0.5, 0.75]
    if approximate:
        quartiles = values.agg(F.percentile_approx("v", shares, 10000)).scalar()
    else:
        counted = stored_table(counted, "value-counts")
        quartiles = F.array(*[F.lit(q).cast("double") for q in exact_quantiles(counted, shares)])
    boxed = counted.select("v", "n", quartiles.alias("q")).select(
        "v", "n", *[F.col("q")[i].alias(name) for i, name in enumerate(("q1", "median", "q3"))]
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("v").between(F.col("q1") - reach, F.col("q3") + reach)
    return boxed.agg(
        F.sum("n").alias("n"),
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"),
    )
