"""Mixing sources to target weights: whole passes over a source, and a subset that fills the rest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.storage import stored
from shelfwise.llm.words import row_key, split_words

MOST_REPEATS = 3
#: Words left to the exact search once the lengths have their proportional share.
SEARCHED_WORDS = 1 << 14
#: Rows of one source and length that are put in order together, on average.
ORDERED_ROWS = 1024


def code_point_weights(sources: DataFrame) -> DataFrame:
    """``weight`` 1, 2, 3, 1, ... of the sources by code point, NULL last.

    Each range of sources is numbered on its own, behind those of the ranges before it; only the ranges,
    as many as there are shuffle partitions, are put in order together.
    """
    order = F.col("source").asc_nulls_last()
    # Stored, so that a source stays in the range it was counted in.
    ranged = stored(sources.repartitionByRange(order).withColumn("range", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("range").agg(F.count("*").alias("n")).select(
        "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    place = F.row_number().over(Window.partitionBy("range").orderBy(order)) + F.col("before")
    return ranged.join(counts, "range").withColumn("weight", ((place - 1) % 3 + 1).cast("int")).drop("range", "before")


def share_targets(sources: DataFrame, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """``target`` of each source from ``source_size`` and ``weight``; together they are all sizes.

    Shares go by weight; none exceeds ``most_repeats`` times its source's size, and what one may not
    take is shared by weight among the others until none is above. Each pass is one small aggregate.
    """
    most = most_repeats * F.col("source_size")

    def shares(rate: float) -> tuple[float, int]:
        over = F.lit(rate) * F.col("weight") > most
        total, fixed, weight, n = sources.agg(
            F.sum("source_size"), F.sum(F.when(over, most)),
            F.sum(F.when(~over, F.col("weight"))), F.count_if(over),
        ).first()
        return ((total or 0) - (fixed or 0)) / weight if weight else rate, n

    rate, before = shares(0.0)[0], 0
    while True:
        next_rate, over = shares(rate)
        if over == before:
            break
        rate, before = next_rate, over
    return sources.withColumn("target", F.least(F.lit(rate) * F.col("weight"), most.cast("double")))


def _closest_subset(sizes: np.ndarray, counts: np.ndarray, wanted: int) -> dict[int, int]:
    """How many of each size add up closest to ``wanted``, the smaller sum if two are as close.

    Bounded knapsack over sums: bit s of an integer tells whether s can be reached. Each size comes in
    parts of one, two, four ... rows, so that any number of rows is a choice of parts.
    """
    limit = 2 * wanted  # nothing at all is as close as what lies beyond
    usable = [(int(s), min(int(c), limit // int(s))) for s, c in zip(sizes, counts, strict=True)]
    mask, reach, steps = (1 << limit + 1) - 1, 1, []
    for size, count in usable:
        part = 1
        while count > 0 and not reach >> wanted & 1:
            part = min(part, count)
            steps.append((reach, size, part))
            reach = (reach | reach << size * part) & mask
            count, part = count - part, part * 2
    below = (reach & (1 << wanted + 1) - 1).bit_length() - 1
    above = reach >> wanted + 1
    total = below
    if above:
        next_sum = wanted + 1 + (above & -above).bit_length() - 1
        total = next_sum if next_sum - wanted < wanted - below else below
    chosen: dict[int, int] = {}
    for before, size, part in reversed(steps):
        if not before >> total & 1:
            total -= size * part
            chosen[size] = chosen.get(size, 0) + part
    return chosen


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: float,
               searched: int = SEARCHED_WORDS) -> np.ndarray:
    """How many rows of each size to take, so that their sizes add up to nearly ``budget``.

    Sizes are positive, different and ascending. Each first has its share of the budget, from the largest down,
    what a size cannot spend passing to the next. Then small ones are put back until ``searched`` words
    or more are free, and the subset of the free rows that fills them best is searched exactly.
    """
    whole, free = int((sizes * counts).sum()), int(round(budget))
    take, carried = np.zeros(len(sizes), np.int64), 0.0
    for i in range(len(sizes) - 1, -1, -1):
        carried += budget / whole * int(sizes[i]) * int(counts[i]) if whole else 0.0
        take[i] = min(int(counts[i]), int(carried // sizes[i]), free // int(sizes[i]))
        carried -= int(take[i]) * int(sizes[i])
        free -= int(take[i]) * int(sizes[i])
    for i in range(len(sizes)):
        if free >= searched:
            break
        back = min(int(take[i]), -(-(searched - free) // int(sizes[i])))
        take[i] -= back
        free += back * int(sizes[i])
    place = {int(s): i for i, s in enumerate(sizes)}
    for size, n in _closest_subset(sizes, counts - take, free).items():
        take[place[size]] += n
    return take


def _quotas(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("size").reset_index(drop=True)
    whole, target = int(group["source_size"][0]), float(group["target"][0])
    passes = int(target // whole)
    take = fit_budget(group["size"].to_numpy(), group["n"].to_numpy(), target - passes * whole)
    return group.assign(passes=passes, take=take)[["source_key", "size", "source_size", "target", "n", "passes", "take"]]


def _hashable(df: DataFrame) -> list[Column]:
    """All columns; as JSON those with maps, which Spark does not hash."""
    return [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
            for f in df.schema.fields]


def mix_sources(documents: DataFrame, size: Column | None = None, seed: int = 17) -> DataFrame:
    """``row`` (all columns), ``size``, ``source_size``, ``target`` and ``repeats`` of every document.

    ``size`` counts words between ASCII white space unless another column is given; ``repeats`` is how often
    the mix has the row: the whole passes its source's target allows, and one more for the rows that fill the
    rest. For these, rows are counted by source and length; each source's lengths, a bounded number
    of them, are fitted in a task of its own; and as many rows of a length are taken in the order of
    a seeded hash of their content. Rows of one length are dealt by that hash to groups that are ordered
    on their own, so a common length of a large source is not sorted in one place.

    A NULL source is a source, the last one. A NULL or empty text has size 0 and is taken as often as its
    source passes whole, which is no word. Rows are drawn by all their columns: only rows that are equal
    throughout are told apart by nothing, and any of them may be taken. Where all sizes are 0, targets are 0;
    an empty table gives none. Reruns agree.
    """
    size = F.size(split_words(F.col("text"))) if size is None else size
    key = F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("source")))
    rows = documents.select(
        F.struct("*").alias("row"), "source", key.alias("source_key"), size.cast("long").alias("size"),
        F.xxhash64(F.lit(seed), row_key(*_hashable(documents))).alias("draw"),
    )
    lengths = stored(rows.groupBy("source", "source_key", "size").agg(F.count("*").alias("n")), "lengths")
    sources = stored(code_point_weights(
        lengths.groupBy("source", "source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    ), "sources")
    targets = stored(share_targets(sources).select("source_key", "source_size", "target"), "targets")
    fitted = stored(
        lengths.filter("size > 0").join(targets, "source_key").select("source_key", "size", "source_size", "target", "n")
        .groupBy("source_key").applyInPandas(
            _quotas, "source_key string, size long, source_size long, target double, n long, passes long, take long"
        ), "quotas",
    )
    passes = fitted.groupBy("source_key").agg(F.max("passes").alias("passes"))
    empty = lengths.filter("size = 0").join(targets, "source_key").join(passes, "source_key", "left").select(
        "source_key", "size", "source_size", "target", "n", F.coalesce("passes", F.lit(0)).alias("passes"),
        F.lit(0).cast("long").alias("take"),
    )
    quotas = fitted.union(empty)
    partly = (F.col("take") > 0) & (F.col("take") < F.col("n"))
    group = F.when(partly, F.pmod("draw", F.ceil(F.col("n") / ORDERED_ROWS))).otherwise(F.pmod("draw", F.lit(1 << 20)))
    placed = rows.drop("source").join(quotas, ["source_key", "size"]).withColumn("group", group)
    slim = rows.select("source_key", "size", "draw").join(
        quotas.filter(partly).filter(F.col("n") > ORDERED_ROWS).select("source_key", "size", "n", "take"), ["source_key", "size"]
    ).withColumn("group", F.pmod("draw", F.ceil(F.col("n") / ORDERED_ROWS)))
    earlier = Window.partitionBy("source_key", "size").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    before = slim.groupBy("source_key", "size", "group").agg(F.count("*").alias("m")).select(
        "source_key", "size", "group", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before")
    )
    ordered = Window.partitionBy("source_key", "size", "group").orderBy("draw")
    place = F.row_number().over(ordered) + F.coalesce("before", F.lit(0))
    return placed.join(before, ["source_key", "size", "group"], "left").withColumn("place", place).select(
        "row", "size", "source_size", "target",
        # A length taken whole, or not at all, needs no order.
        (F.col("passes") + (
            (F.col("n") == F.col("take")) | (partly & (F.col("place") <= F.col("take")))
        ).cast("long")).alias("repeats"),
    )


def write_out(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken, its columns as they were."""
    return mixed.filter("repeats > 0").select(
        "row.*", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("copy of the row")
    ).drop("copy of the row")
