"""Ranked lexical search by dense products of item tiles and document tiles.

Documents are reduced once to the terms that some item has, and stored so. A tile of items has a compact vocabulary, that of its
items alone; its weights are a dense matrix of items by terms, and a tile of documents is a dense matrix of terms by documents that holds
their impacts. Both hold whole numbers in float64, and a vocabulary tile is so narrow that no sum of its products
reaches 2^53: every product is exact, in any order of summing. Tiles are added up as 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.storage import stored

#: Items of a block are as many as fit these bytes of text, one at least; a block is one pass over the reduced documents.
BLOCK_BYTES = 1 << 20
ITEMS_PER_TILE = 256
DOCUMENTS_PER_TILE = 512
TERMS_PER_TILE = 2048
#: Texts are read in pieces of this many bytes, cut between terms.
PIECE_BYTES = 1 << 22
#: No impact reaches this.
MOST_IMPACT = 1_000_000
_EXACT = 1 << 53
_SALTS = 32

_BETWEEN = bytes(b for b in range(128) if not chr(b).isalnum())
_TO_BLANK = bytes.maketrans(_BETWEEN, b" " * len(_BETWEEN))


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text, A-Z lower-cased, in lists of bounded size: runs of ASCII letters, digits and all beyond ASCII."""
    plain = (text or b"").lower().translate(_TO_BLANK)  # bytes.lower changes A-Z only
    if len(plain) <= PIECE_BYTES:
        yield plain.split()
        return
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE_BYTES)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


@dataclass(frozen=True)
class Block:
    """Some items: their ids, and their terms as places in the block's vocabulary."""

    items: list
    terms: list[np.ndarray]
    vocabulary: list[bytes]


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[Block]:
    """Items in blocks; one block is in the driver at a time. Every row is an item of its own; no terms, no results."""
    ids, terms, places, size = [], [], {}, 0

    def block() -> Block:
        return Block(ids, terms, list(places))

    for row in items.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator():
        found = {t for part in terms_of(row.text) for t in part}
        if not found:
            continue
        if ids and size + len(row.text) > block_bytes:
            yield block()
            ids, terms, places, size = [], [], {}, 0
        ids.append(row.item_id)
        terms.append(np.array(sorted(places.setdefault(t, len(places)) for t in found), np.int64))
        size += len(row.text)
    if ids:
        yield block()


# ---------------------------------------------------------------------------------------- documents


def reduce_documents(documents: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Stored (doc_id, n, terms, counts): length in terms, and how often each term of the vocabulary occurs.

    Documents without any term are left out: they count nowhere. Terms and counts are packed as 32-bit integers.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(vocabulary)}
        for batch in batches:
            lengths, terms, counts = [], [], []
            for text in batch.column(1).to_pylist():
                n, found = 0, Counter()
                for part in terms_of(text):
                    n += len(part)
                    found.update(map(place.get, part))
                found.pop(None, None)
                lengths.append(n)
                terms.append(np.fromiter(found.keys(), np.int32, len(found)).tobytes())
                counts.append(np.fromiter(found.values(), np.int32, len(found)).tobytes())
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())],
                names=["doc_id", "n", "terms", "counts"],
            )
            yield out.filter(pc.greater(out.column("n"), 0))

    return stored(
        documents.select("doc_id", F.col("text").cast("binary").alias("text"))
        .mapInArrow(run, f"doc_id {kind}, n bigint, terms binary, counts binary"), "reduced",
    )


def document_frequencies(reduced: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term occurs, added up in every task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
            seen += np.bincount(flat, minlength=size)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["term", "df"])

    sums = reduced.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    found = np.zeros(size, np.int64)
    for row in sums.toLocalIterator():  # at most the block's vocabulary
        found[row.term] = row.df
    return found


# ------------------------------------------------------------------------------------------ scoring


@dataclass(frozen=True)
class Tile:
    """Weights of some items on some terms: ``dense[rows, columns] = weights``, the terms in ascending order."""

    first: int
    items: int
    terms: np.ndarray
    rows: np.ndarray
    columns: np.ndarray
    weights: np.ndarray

    def dense(self) -> np.ndarray:
        full = np.zeros((self.items, len(self.terms)))
        full[self.rows, self.columns] = self.weights
        return full

    def impacts(self, flat: np.ndarray, document: np.ndarray, impact: np.ndarray, documents: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, flat), len(self.terms) - 1)
        inside = self.terms[at] == flat
        full = np.zeros((len(self.terms), documents))
        full[at[inside], document[inside]] = impact[inside]
        return full


def cut_tiles(terms: list[np.ndarray], weight: np.ndarray) -> list[Tile]:
    """Tiles of some items each, by their own terms only, so narrow that no sum of products reaches 2^53."""
    width = max(1, min(TERMS_PER_TILE, (_EXACT - 1) // (MOST_IMPACT * max(1, int(weight.max(initial=1))))))
    tiles = []
    for first in range(0, len(terms), ITEMS_PER_TILE):
        some = terms[first:first + ITEMS_PER_TILE]
        row, flat = np.repeat(np.arange(len(some)), [len(t) for t in some]), np.concatenate(some)
        compact = np.unique(flat)
        column = np.searchsorted(compact, flat)
        for at in range(0, len(compact), width):
            inside = (column >= at) & (column < at + width)
            tiles.append(Tile(first, len(some), compact[at:at + width], row[inside], column[inside] - at, weight[flat[inside]]))
    return tiles


def _scored(reduced: DataFrame, block: Block, n_documents: int, n_terms: int, frequencies: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): of every task the k best documents of each item, by place of the item in the block."""
    kind = reduced.schema["doc_id"].dataType.simpleString()
    weight = np.array(
        [math.floor(1000 * math.log((2 * n_documents + 2) / (2 * int(f) + 1))) for f in frequencies], np.int64
    )
    n_items, shared = len(block.items), reduced.sparkSession.sparkContext.broadcast(cut_tiles(block.terms, weight))

    def tile_scores(n: np.ndarray, terms: list[bytes], counts: list[bytes]) -> np.ndarray:
        flat, tf = np.frombuffer(b"".join(terms), np.int32), np.frombuffer(b"".join(counts), np.int32).astype(np.int64)
        row = np.repeat(np.arange(len(n)), [len(t) // 4 for t in terms])
        m = 10 + (90 * n * n_documents) // n_terms
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
        scores = np.zeros((n_items, len(n)), np.int64)
        for tile in shared.value:
            product = tile.dense() @ tile.impacts(flat, row, impact, len(n))
            scores[tile.first:tile.first + tile.items] += product.astype(np.int64)
        return scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_item, best_score, best_id = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        floor = np.ones(n_items, np.int64)  # what a document needs to be among the k best so far
        for batch in batches:
            for at in range(0, batch.num_rows, DOCUMENTS_PER_TILE):
                ids, n, terms, counts = batch.slice(at, DOCUMENTS_PER_TILE).columns
                scores = tile_scores(n.to_numpy(), terms.to_pylist(), counts.to_pylist())
                need = floor
                if scores.shape[1] > k:
                    need = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k])
                item, place = np.nonzero(scores >= need[:, None])
                if not len(item):
                    continue
                found = ids.take(pa.array(place))
                best_id = found if best_id is None else pa.concat_arrays([best_id, found])
                best_item = np.concatenate([best_item, item])
                best_score = np.concatenate([best_score, scores[item, place]])
                # Ties go to the lesser id, NULL last, before anything is cut off.
                by_id = pc.rank(best_id, "ascending", null_placement="at_end", tiebreaker="dense").to_numpy()
                order = np.lexsort((by_id, -best_score, best_item))
                starts = np.searchsorted(best_item[order], np.arange(n_items))
                order = order[np.arange(len(order)) - starts[best_item[order]] < k]
                best_item, best_score, best_id = best_item[order], best_score[order], best_id.take(pa.array(order))
                full, which = np.bincount(best_item, minlength=n_items) >= k, np.searchsorted(best_item, np.arange(n_items))
                floor[full] = best_score[which[full] + k - 1]
        if best_id is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(best_item.astype(np.int32)), best_id, pa.array(best_score)], names=["item", "doc_id", "score"]
            )

    return reduced.mapInArrow(run, f"item int, doc_id {kind}, score bigint")


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each item, first among salted parts of them and then among these parts' best."""
    order = F.desc("score"), F.asc_nulls_last("doc_id")
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order)))
    again = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return first.filter(F.col("rank") <= k).withColumn("rank", again).filter(F.col("rank") <= k).drop("salt")


def search(documents: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0, equal ones by ``doc_id``.

    ``documents`` has ``doc_id`` and ``text``, ``items`` have ``item_id`` and ``text``; other columns are not read.
    Every row is a document of its own and every row an item of its own, repeated ones too; a NULL or empty text has no
    terms and no results, a NULL ``doc_id`` stands after the others. Texts may be of any length. An empty table on
    either side gives no rows. Items are worked on in blocks of bounded size; a block reads all documents once.
    """
    spark = documents.sparkSession
    id_kind, doc_kind = items.schema["item_id"].dataType.simpleString(), documents.schema["doc_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"item_id {id_kind}, rank int, doc_id {doc_kind}, score bigint")
    for block in _blocks(items, block_bytes):
        reduced = reduce_documents(documents, block.vocabulary)
        total = reduced.agg(F.count("*").alias("n"), F.sum("n").alias("terms")).first()
        if not total.n:
            break
        frequencies = document_frequencies(reduced, len(block.vocabulary))
        best = stored(_best(_scored(reduced, block, total.n, total.terms, frequencies, k), k), "ranked")
        names = spark.createDataFrame(list(enumerate(block.items)), f"item int, item_id {id_kind}")
        found = found.unionByName(best.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return found
