"""Connected components by contracting edges in rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.storage import stored


def _by_hash(node: str) -> Column:
    return F.struct(F.xxhash64(node).alias("h"), F.col(node).alias("n"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node of ``edges`` (columns ``a`` and ``b``, 64-bit integers).

    In a round every node moves onto the least of itself and its neighbours, in the order of a hash,
    and edges whose ends have met go. The hash order leaves a fixed share of the nodes in a
    round on average, chains included, so the rounds grow as the logarithm of the nodes. Only the
    number of edges left reaches the driver; what a round leaves is stored in the shared folder.
    A node's minimum is taken before the shuffle too, so a node with very many edges is no hot key.
    Edges may repeat, join a node with itself, or be none.
    """
    edges = stored(edges.select("a", "b").distinct(), "edges")
    labels = stored(
        edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        .withColumn("root", F.col("node")), "labels",
    )
    edges = edges.filter("a <> b")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        moves = stored(
            both.groupBy("a").agg(F.min(_by_hash("b")).alias("least"))
            .select(F.col("a").alias("old"), F.least(_by_hash("a"), F.col("least"))["n"].alias("new")),
            "moves",
        )
        labels = stored(
            labels.join(moves, labels["root"] == moves["old"], "left")
            .select("node", F.coalesce("new", "root").alias("root")), "labels",
        )
        at_a, at_b = (
            moves.select(F.col("old").alias(end), F.col("new").alias(f"to_{end}")) for end in "ab"
        )
        edges = stored(
            edges.join(at_a, "a").join(at_b, "b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
            .filter("a <> b").distinct(), "edges",
        )
    return labels
