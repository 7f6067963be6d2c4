"""Repeated passages: Rabin-Karp hashes of every window of words, counted in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.chunks import body_of, each_chunk, pack_texts, word_counts
from shelfwise.llm.storage import stored

WINDOW = 35
#: Bytes of a window in the shuffle: 64 bits of one hash, 16 of another that also picks the bucket.
ENTRY_BYTES = 10
BUCKET_BYTES = 16 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def rolling_hashes(values: np.ndarray, window: int, base: int) -> np.ndarray:
    """The polynomial hash modulo 2**64 of every window of ``values`` (64-bit hashes of the words).

    It differs from the hash of the window before by one value that comes and one that goes: with
    ``values[i] * base**i`` summed up, a window is the difference of two sums, scaled back.
    """
    n = len(values)
    if n < window:
        return np.zeros(0, np.uint64)
    up = np.full(n, base, np.uint64)
    back = np.full(n - window + 1, pow(base, -1, 1 << 64), np.uint64)
    up[0] = back[0] = 1
    with np.errstate(over="ignore"):
        up, back = np.cumprod(up), np.cumprod(back)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up, dtype=np.uint64)))
        hashes = (sums[window:] - sums[:-window]) * back
        # Low bits of a product hang on low bits only: mix them with the high ones.
        hashes ^= hashes >> np.uint64(32)
        hashes *= np.uint64(0xD6E8FEB86659FD93)
        return hashes ^ (hashes >> np.uint64(32))


def _windows(body: bytes, window: int, buckets: int):
    """Windows of a chunk: their starts, and first and second hash, those across two texts left out.

    With them the bucket of each, the order that sorts them by bucket and first hash, and where a new
    hash begins in that order.
    """
    counts = word_counts(body)
    words = body.split()
    values = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    ends = np.repeat(np.cumsum(counts), counts)
    starts = np.flatnonzero(np.arange(len(words)) + window <= ends)
    first = rolling_hashes(values, window, _BASES[0])[starts]
    second = rolling_hashes(values, window, _BASES[1])[starts]
    bucket = ((second >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((first, bucket))
    new = np.ones(len(order), bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])
    return counts, words, starts, first, second, bucket, order, new


def _entries(window: int, buckets: int):
    def work(row: dict) -> Iterator[list]:
        _, _, _, first, second, bucket, order, new = _windows(body_of(row), window, buckets)
        sent = order[new]
        cuts = np.searchsorted(bucket[sent], np.arange(buckets + 1))
        h, x = first[sent], (second[sent] & np.uint64(0xFFFF)).astype(np.uint16)
        full = np.flatnonzero(np.diff(cuts))
        yield [
            pa.array(full.astype(np.int32)), pa.array([row["chunk"].as_py()] * len(full), pa.int64()),
            pa.array([h[cuts[b]:cuts[b + 1]].tobytes() for b in full], pa.binary()),
            pa.array([x[cuts[b]:cuts[b + 1]].tobytes() for b in full], pa.binary()),
        ]

    return each_chunk(work, ["bucket", "chunk", "first", "second"])


def _met_elsewhere(table: pa.Table) -> pa.Table:
    """Of the windows of one bucket, as bits in the order they came, those other chunks have too."""
    first, second = (
        [np.frombuffer(v.as_py(), kind) for v in table.column(n)]
        for n, kind in (("first", np.uint64), ("second", np.uint16))
    )
    h, x = np.concatenate(first), np.concatenate(second)
    order = np.argsort(h)
    near = (h[order][1:] == h[order][:-1]) & (x[order][1:] == x[order][:-1])
    met = np.zeros(len(h), bool)
    met[order[1:][near]] = True
    met[order[:-1][near]] = True
    parts = np.split(met, np.cumsum([len(p) for p in first])[:-1])
    some = [i for i, p in enumerate(parts) if p.any()]
    return pa.table({
        "bucket": table.column("bucket").take(pa.array(some, pa.int64())),
        "chunk": table.column("chunk").take(pa.array(some, pa.int64())),
        "bits": pa.array([np.packbits(parts[i]).tobytes() for i in some], pa.binary()),
    }).cast(pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("bits", pa.binary())]))


def _removals(window: int, buckets: int):
    def work(row: dict) -> Iterator[list]:
        counts, words, starts, _, _, bucket, order, new = _windows(body_of(row), window, buckets)
        group = np.cumsum(new) - 1  # of each window in order, the place of its hash among those sent
        repeated = np.bincount(group, minlength=1) > 1 if len(order) else np.zeros(0, bool)
        cuts = np.searchsorted(bucket[order[new]], np.arange(buckets + 1))
        for answer in row["met"].as_py() or []:
            b = answer["bucket"]
            bits = np.unpackbits(np.frombuffer(answer["bits"], np.uint8))
            repeated[cuts[b]:cuts[b + 1]] |= bits[:cuts[b + 1] - cuts[b]].astype(bool)
        at = starts[order[repeated[group]]] if len(order) else starts
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + window, -1)
        gone = np.cumsum(edges[:-1]) > 0
        change = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
        begins, ends = change[::2], change[1::2]
        last = np.cumsum(counts)
        spans, texts = [], []
        for stop, n in zip(last.tolist(), counts.tolist(), strict=True):
            start = stop - n
            i, j = np.searchsorted(begins, (start, stop))
            # Neighbouring texts may both be covered where they touch: an interval can cross the border.
            i0 = i - 1 if i and ends[i - 1] > start else i
            own = [(max(int(b), start) - start, min(int(e), stop) - start)
                   for b, e in zip(begins[i0:j], ends[i0:j], strict=True)]
            spans.append([{"start": b, "end": e} for b, e in own])
            kept, here = [], start
            for b, e in own:
                kept += words[here:start + b]
                here = start + e
            texts.append(b" ".join(kept + words[here:stop]).decode())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield [row["ids"].values, pa.array(counts), pa.array(spans, span), pa.array(texts, pa.string())]

    return each_chunk(work, ["doc_id", "n_words", "spans", "kept"])


def remove_repeats(documents: DataFrame, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id``, ``n_words``, ``spans`` and ``kept`` of every row.

    A window is ``window`` consecutive words of a text, words being what lies between ASCII white space. Each
    window whose words also start anywhere else, in the same text or another, goes; ``spans`` has the
    maximal intervals of words that go (``start`` to ``end``, the end not included), ``kept`` the words
    left, joined by a blank. Windows are judged on the input. A NULL or empty text has no words; a
    text shorter than the window keeps all; repeated rows are copies of each other.

    Texts are packed into stored chunks. A chunk sends each different window once, however often it
    has it, as 80 bits in a binary for each bucket of hashes, so a passage found everywhere is one entry a
    chunk. Buckets are sized by the number of words. A bucket answers which entries other chunks have too;
    the chunk, read again, adds those it repeats itself. Equal hashes count as equal windows: with the
    bits that pick the bucket, over 96 differ where there are 65,536 buckets.
    """
    chunks = pack_texts(documents, "chunks")
    words = chunks.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(
        -(-words * ENTRY_BYTES // bucket_bytes), int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    )
    entries = chunks.select("chunk", "body").mapInArrow(
        _entries(window, buckets), "bucket int, chunk long, first binary, second binary"
    )
    met = stored(
        entries.groupBy("bucket").applyInArrow(_met_elsewhere, "bucket int, chunk long, bits binary"), "met"
    )
    answers = met.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("met"))
    answered = chunks.join(answers, "chunk", "left").select("ids", "body", "met")
    return answered.mapInArrow(
        _removals(window, buckets),
        "doc_id long, n_words long, spans array<struct<start:bigint,end:bigint>>, kept string",
    )
