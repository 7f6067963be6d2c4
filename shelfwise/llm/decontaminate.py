"""Benchmark decontamination: windows of benchmark words looked up in every text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.words import ascii_lower, row_key, split_alphanumeric, window_hashes

WINDOW = 10
#: Different benchmark windows that are broadcast at most; beyond it the join is shuffled.
BROADCAST_WINDOWS = 1_000_000


def _gram(words: str, at: Column, length: int) -> Column:
    return F.array_join(F.slice(words, at, length), " ")


def benchmark_windows(benchmark: DataFrame, length: int, whole: bool) -> DataFrame:
    """``gram`` (words joined by a blank), ``hash`` and ``items`` of every window of ``length`` words.

    ``whole``: of texts that have just as many words.
    """
    words = benchmark.select("item_id", split_alphanumeric(ascii_lower(F.col("text"))).alias("words"))
    size = F.size("words")
    windows = words.filter(size == length if whole else size >= length).select(
        "item_id", "words", F.posexplode_outer(window_hashes("words", length)).alias("at", "hash")
    )
    return (
        windows.groupBy(_gram("words", F.col("at") + 1, length).alias("gram"), "hash")
        .agg(F.collect_set("item_id").alias("items"))
    )


def _hits(read: DataFrame, benchmark: DataFrame, length: int, whole: bool, limit: int) -> DataFrame:
    """``key``, place, length and items of every window of ``length`` words that the texts share."""
    windows = benchmark_windows(benchmark, length, whole)
    # Outer, though texts without windows are not wanted: an inner one is filtered by its windows first,
    # for which the optimizer would write out, and evaluate, all that makes them once more.
    if windows.count() <= limit:
        probes = read.select("key", "words", window_hashes("words", length).alias("hashes"))
        hits = (
            probes.select("key", "words", F.posexplode_outer("hashes").alias("at", "hash"))
            .join(F.broadcast(windows), "hash")
            .filter(_gram("words", F.col("at") + 1, length) == F.col("gram"))
        )
    else:
        starts = F.when(F.size("words") >= length, F.sequence(F.lit(1), F.size("words") - length + 1))
        grams = read.select("key", F.transform(starts, lambda i: _gram("words", i, length)).alias("grams"))
        hits = grams.select("key", F.posexplode_outer("grams").alias("at", "gram")).join(windows, "gram")
    return hits.select("key", (F.col("at") + 1).alias("at"), F.lit(length).alias("size"), "items")


def find_contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> tuple[DataFrame, DataFrame]:
    """Texts as words, and what was found in them.

    The first frame has ``row`` (all columns of ``documents``), ``key`` and ``n_words``. The second has
    one row for each ``key`` with a hit: ``spans`` (position and length of every occurrence, in words)
    and ``items``. A benchmark text of fewer words than a window is one window; one without words is
    none. An item without id hits words, but is not in ``items``.

    The hash set of windows is broadcast if it has at most ``broadcast_windows`` rows: hashes of text
    windows are probed and each hit is verified by its words. Beyond that the windows' words are the
    key of a shuffled join. Texts never leave their task; only hits are shuffled.
    """
    sizes = F.least(F.size(split_alphanumeric(ascii_lower(F.col("text")))), F.lit(window))
    # At most one row for each length.
    lengths = {r["length"] for r in benchmark.select(sizes.alias("length")).distinct().collect()} - {0}
    read = documents.select(
        F.struct("*").alias("row"),
        row_key(F.col("doc_id"), F.col("text")).alias("key"),
        split_alphanumeric(ascii_lower(F.col("text"))).alias("words"),
    )
    texts = read.select("row", "key", F.size("words").cast("long").alias("n_words"))
    hits = [_hits(read, benchmark, n, n < window, broadcast_windows) for n in sorted(lengths or {window})]
    hits = reduce(DataFrame.union, hits)
    hits = hits.groupBy("key").agg(
        F.collect_set(F.struct("at", "size")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    return texts, hits


def report_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each row: ``doc_id``, ``n_words``, ``n_hit`` (words inside an occurrence of a window),
    ``n_items``, ``items`` and ``contaminated``.

    A NULL or empty text has no words and no hit. Repeated rows are each reported. An empty benchmark
    hits nothing.
    """
    texts, hits = find_contamination(documents, benchmark, window)
    covered = F.array_distinct(F.flatten(F.transform(
        "spans", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1)
    )))
    counted = hits.select("key", "items", F.size(covered).cast("long").alias("hit"))
    return texts.join(counted, "key", "left").select(
        "row.doc_id", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        F.col("hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``documents`` without any benchmark window, all columns as they were."""
    _, hits = find_contamination(documents, benchmark, window)
    key = row_key(F.col("row.doc_id"), F.col("row.text"))
    rows = documents.select(F.struct("*").alias("row")).withColumn("key", key)
    return rows.join(hits.select("key"), "key", "left_anti").select("row.*")


def remove_spans(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id`` and ``text`` as the words outside every occurrence, joined by a blank.

    Texts without a hit, NULL ones too, stay as they are.
    """
    _, hits = find_contamination(documents, benchmark, window)
    words = split_alphanumeric(ascii_lower(F.col("text")))
    rows = documents.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("key"))
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1)))
    left = rows.join(hits.select("key", F.array_distinct(covered).alias("gone")), "key", "left")
    outside = F.array_except(F.sequence(F.lit(1), F.size("words")), F.col("gone"))
    return left.withColumn("words", F.when(F.col("gone").isNotNull(), words)).select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text"))
        .otherwise(F.array_join(F.transform(outside, lambda i: F.get("words", i - 1)), " "))
        .alias("text"),
    )
