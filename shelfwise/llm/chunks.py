"""Texts packed into chunks of a few megabytes, the unit in which window operators work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from shelfwise.llm.storage import stored

CHUNK_BYTES = 4 << 20

SCHEMA = "chunk long, ids array<bigint>, flags array<boolean>, n_words long, body binary"


def pack_texts(documents: DataFrame, name: str, lower: bool = False,
               chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Stored chunks of ``documents`` (``doc_id``, ``text`` and optionally a boolean ``flag``).

    ``body`` has a line for each text: its words between ASCII white space, joined by a blank, with A-Z
    lower-cased if asked; it is compressed (see ``body_of``). A NULL text is an empty line. A chunk ends
    after the text that fills it, so it is as large as ``chunk_bytes`` and one text at most. It is named by
    the task that made it and its place there; as the table is stored before anything reads it, a
    task that ran twice does no harm.
    """
    flagged = "flag" in documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, flags, lines, size, words = [], [], [], 0, 0
        name = TaskContext.get().partitionId() << 24

        def chunk() -> pa.RecordBatch:
            values = [name], [ids], [flags], [words], [zstandard.compress(b"\n".join(lines) + b"\n", 1)]
            kinds = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64(), pa.binary()
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(values, kinds, strict=True)],
                names=["chunk", "ids", "flags", "n_words", "body"],
            )

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                text = (row[1] or "").encode()
                found = (text.lower() if lower else text).split()
                lines.append(b" ".join(found))
                ids.append(row[0])
                flags.append(bool(row[2]) if flagged else False)
                size += len(lines[-1]) + 1
                words += len(found)
                if size >= chunk_bytes:
                    yield chunk()
                    ids, flags, lines, size, words = [], [], [], 0, 0
                    name += 1
        if lines:
            yield chunk()

    columns = ["doc_id", "text", "flag"] if flagged else ["doc_id", "text"]
    return stored(documents.select(*columns).mapInArrow(run, SCHEMA), name)


def body_of(row: dict) -> bytes:
    return zstandard.decompress(row["body"].as_py())


def word_counts(body: bytes) -> np.ndarray:
    """Number of words of each line."""
    return np.fromiter((line.count(b" ") + 1 if line else 0 for line in body.split(b"\n")[:-1]), np.int64)


def each_chunk(work: Callable, names: list[str]) -> Callable:
    """A function for ``mapInArrow`` that calls ``work`` with the Arrow values of every chunk's row.

    ``work`` yields lists of columns. Rows are taken one at a time, so that one chunk is in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                for columns in work(row):
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run
