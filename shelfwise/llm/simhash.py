"""SimHash near duplicates: fingerprints linked within a few bits by vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.components import connected_components
from shelfwise.llm.storage import stored
from shelfwise.llm.words import row_key

SHINGLE = 3
DISTANCE = 2
#: Different fingerprints a leaf of the shared tree aims at; those of a block in one task at most.
LEAF_ROWS = 4096
BLOCK_ROWS = 32768
#: The shared tree is drawn from this many fingerprints for each leaf, and has at most so many levels.
SAMPLE_PER_LEAF = 16
MAX_LEVELS = 12


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text; zero where it has no word."""
    body = b" ".join((text or "").encode().lower().split())
    if not body:
        return 0
    # Words start after blanks; a shingle runs from its first word to the blank after its last.
    blanks = np.flatnonzero(np.frombuffer(body, np.uint8) == 32)
    starts = np.concatenate(([0], blanks + 1)).tolist()
    ends = np.concatenate((blanks, [len(body)])).tolist()
    n = max(1, len(starts) - shingle + 1)
    last = ends[shingle - 1:] if len(starts) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(body[a:b], 42) for a, b in zip(starts[:n], last, strict=True)), np.uint64, n
    )
    ones = np.zeros(64, np.int64)
    for part in range(0, n, 1 << 16):
        block = hashes[part:part + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``key`` (a row's content as 128 bits) and ``fp`` (the bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.fromiter(
                (fingerprint_of(t.as_py(), shingle) for t in batch.column(2)), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(bits.view(np.int64))],
                names=["doc_id", "key", "fp"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), "text").mapInArrow(
        run, f"doc_id {kind}, key string, fp long"
    )


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def plant_tree(sample: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a full tree as a heap: node k has 2k+1 (within) and 2k+2 (beyond).

    A node's vantage point is its least fingerprint, its radius the median distance to it.
    """
    points, radii = np.zeros(2**levels - 1, np.uint64), np.zeros(2**levels - 1, np.int64)
    parts = {0: np.sort(sample)}
    for node in range(2**levels - 1):
        part = parts.pop(node)
        if len(part):
            d = _distance(part, part[0])
            points[node], radii[node] = part[0], int(np.median(d))
            parts[2 * node + 1], parts[2 * node + 2] = part[d <= radii[node]], part[d > radii[node]]
        else:
            parts[2 * node + 1] = parts[2 * node + 2] = part
    return points, radii


def _route(fps: np.ndarray, points: np.ndarray, radii: np.ndarray, distance: int):
    """Leaf of every fingerprint, and the further leaves where it has to look for partners.

    Two fingerprints within ``distance`` that a node parts differ by no more in their distance to its
    vantage point. So one beyond the radius also looks within it if it lies close to the boundary;
    one that only looks takes every branch the triangle bound allows. Returns places in ``fps``,
    leaves, and whether it is at home there.
    """
    at, node = np.arange(len(fps)), np.zeros(len(fps), np.int64)
    home = np.ones(len(fps), bool)
    for _ in range((len(points) + 1).bit_length() - 1):
        d, r = _distance(fps[at], points[node]).astype(np.int64), radii[node]
        within = np.where(home, d <= r, d <= r + distance)
        beyond = np.where(home, d > r, d > r - distance)
        looks = home & (d > r) & (d <= r + distance)
        at = np.concatenate((at[within], at[beyond], at[looks]))
        node = np.concatenate((2 * node[within] + 1, 2 * node[beyond] + 2, 2 * node[looks] + 1))
        home = np.concatenate((home[within], home[beyond], np.zeros(int(looks.sum()), bool)))
    return at, node, home


def _close_pairs(fps: np.ndarray, homes: np.ndarray, others: np.ndarray, distance: int):
    """Places of pairs within ``distance``: of homes among themselves, and of others with homes.

    The same tree goes on inside the leaf until a part is small or a vantage point no longer splits it.
    """
    work = [(homes, others)]
    while work:
        homes, others = work.pop()
        if len(homes) + len(others) < 2 or not len(homes):
            continue
        if len(homes) > 256:
            point = fps[homes[0]]
            d, o = _distance(fps[homes], point).astype(np.int64), _distance(fps[others], point).astype(np.int64)
            r = int(np.median(d))
            if 4 * min((d <= r).sum(), (d > r).sum()) >= len(homes):
                near = homes[(d > r) & (d <= r + distance)]
                work.append((homes[d <= r], np.concatenate((others[o <= r + distance], near))))
                work.append((homes[d > r], others[o > r - distance]))
                continue
        step = max(1, (1 << 20) // len(homes))
        for start in range(0, len(others), step):
            part = others[start:start + step]
            i, j = np.nonzero(_distance(fps[part][:, None], fps[homes][None, :]) <= distance)
            yield part[i], homes[j]
        for start in range(0, len(homes), step):
            part = homes[start:start + step]
            i, j = np.nonzero(_distance(fps[part][:, None], fps[homes[start:]][None, :]) <= distance)
            yield part[i], homes[start:][j]


def _spanning(n: int, pairs: Iterator) -> np.ndarray:
    """Least place reachable from each of ``n`` places by the pairs."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            a, b = root[a], root[b]
            differ = a != b
            if not differ.any():
                break
            a, b = a[differ], b[differ]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
    return root


def find_links(different: DataFrame, distance: int = DISTANCE, leaf_rows: int = LEAF_ROWS,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``a`` and ``b``: links that connect exactly the fingerprints that pairs within ``distance`` do.

    ``different`` has each fingerprint once, as ``fp``, and is stored. The upper levels of one tree,
    drawn from a bounded sample, deal the fingerprints to leaves; those near a boundary are also sent
    to look beyond it. A leaf with more homes than ``block_rows``, such as a dense ball no vantage point
    splits, is cut into blocks that meet pairwise in tasks of their own. A task sends one link for
    each fingerprint it joins to another, not all pairs. The sample, and the number of homes of each
    leaf, come to the driver; both are bounded by ``MAX_LEVELS``.
    """
    n = different.count()
    levels = min(MAX_LEVELS, max(0, (n // leaf_rows).bit_length()))
    sample = different.orderBy(F.xxhash64(F.lit(7), "fp"), "fp").limit(SAMPLE_PER_LEAF * 2**levels)
    points, radii = plant_tree(
        np.array([r["fp"] for r in sample.collect()], np.int64).view(np.uint64), levels
    )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            at, leaf, home = _route(fps, points, radii, distance)
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf), pa.array(fps[at].view(np.int64)), pa.array(home)],
                names=["leaf", "fp", "home"],
            )

    dealt = stored(different.mapInArrow(deal, "leaf long, fp long, home boolean"), "leaves")
    blocks = F.create_map(*[F.lit(x) for row in dealt.filter("home").groupBy("leaf").count()
                            .filter(F.col("count") > block_rows).collect()
                            for x in (row["leaf"], -(-row["count"] // block_rows))]).cast("map<bigint,int>")
    cut = F.coalesce(F.try_element_at(blocks, F.col("leaf")), F.lit(1))
    own = F.pmod(F.xxhash64(F.lit(9), "fp"), F.col("cut")).cast("int")
    # A home looks from its own block into the later ones; one that only looks visits all.
    first = F.when(F.col("home"), own).otherwise(0)
    placed = dealt.withColumn("cut", cut).select(
        "leaf", "fp", F.col("home"), own.alias("own"),
        F.explode(F.sequence(first, F.col("cut") - 1)).alias("block"),
    ).withColumn("home", F.col("home") & (F.col("own") == F.col("block"))).drop("own")

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        fps = table.column("fp").combine_chunks().to_numpy().view(np.uint64)
        home = table.column("home").combine_chunks().to_numpy(zero_copy_only=False)
        root = _spanning(len(fps), _close_pairs(fps, np.flatnonzero(home), np.flatnonzero(~home), distance))
        joined = np.flatnonzero(root != np.arange(len(fps)))
        return pa.table({"a": fps[root[joined]].view(np.int64), "b": fps[joined].view(np.int64)})

    return placed.groupBy("leaf", "block").applyInArrow(meet, "a long, b long")


def near_duplicate_classes(
    documents: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """``doc_id``, ``key``, ``fp``, ``root`` (a fingerprint that names the component) and
    ``component_id`` (the least ``doc_id`` reachable) of every row.

    Fingerprints link at ``distance`` differing bits or fewer; equal ones are counted as one before
    the search. A NULL or empty text has fingerprint zero and links like any other; repeated rows are
    each reported; NULL ids take part, but are no component's id unless it has no other. No rows give
    no rows. The fingerprints are stored once, so texts are read once.
    """
    prints = stored(fingerprints(documents, shingle), "fingerprints")
    groups = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "different")
    roots = connected_components(find_links(groups.select("fp"), distance))
    rooted = groups.join(roots, groups["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(named, "root").select("fp", "root", "component_id"), "fp")


def as_hex(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def keep_one_of_each(documents: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of each component, all its columns as they were: the one with the least ``doc_id``.

    NULL ids come last. Among rows with the same id, the least hash of the content decides, then the
    least hash of the whole row.
    """
    classes = near_duplicate_classes(documents, shingle, distance)
    chosen = classes.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias("key")
    ).select("key")
    rows = documents.select(F.struct("*").alias("row")).withColumn(
        "key", row_key(F.col("row.doc_id"), F.col("row.text"))
    )
    equal = Window.partitionBy("key").orderBy(F.xxhash64("row"))
    return (
        rows.join(chosen, "key", "left_semi")
        .withColumn("place", F.row_number().over(equal)).filter("place = 1").select("row.*")
    )
