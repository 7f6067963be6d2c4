"""Token ids as directly addressable codes: any token can be read without decoding a block."""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import compress, pairwise
from operator import not_
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.words import row_key

#: Bits of a chunk, and bits of a bitmap between two entries of its rank directory.
CHUNK_BITS = 8
RANK_EVERY = 512
SHARD_TOKENS = 1 << 22
#: Parts of words, and words encoded whole, whose ids an encoder remembers; beyond that it forgets all, or all but those at hand.
REMEMBERED = 400_000
#: Bytes of the texts that are encoded at once, one text at least: the more, the fewer words are met again.
TEXT_BYTES = 1 << 24
#: Stands between the ids of words; no place in the codes of ids reads like it, for their upper bytes are zero.
BREAK = b"\xff\xff\xff\xff"

SHARD = (
    "part int, shard int, doc_ids array<bigint>, sizes array<bigint>, n_tokens long, "
    "levels array<binary>, more array<binary>, ranks array<binary>"
)


def pack_codes(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, continuation bitmaps and rank directories of each level.

    Level 0 has the lowest eight bits of every id, level k the k-th eight bits of those ids that go
    on to it. The bitmap of a level has a one for each chunk whose id goes on; its directory has the number
    of ones before every 512th bit, so the place in the next level is one lookup and a count within 64 bytes.
    """
    levels, more, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        on = rest >> CHUNK_BITS != 0
        levels.append((rest & 0xFF).astype(np.uint8).tobytes())
        more.append(np.packbits(on, bitorder="little").tobytes())
        ones = np.concatenate(([0], np.cumsum(on)))
        ranks.append(ones[:-1:RANK_EVERY].astype("<u8").tobytes() if len(rest) else b"")
        rest = rest[on] >> CHUNK_BITS
        if not len(rest):
            return levels, more, ranks


class TokenReader:
    """Random access to the ids of one shard."""

    def __init__(self, levels: list[bytes], more: list[bytes], ranks: list[bytes]) -> None:
        self.levels = [np.frombuffer(x, np.uint8) for x in levels]
        self.more = [np.frombuffer(x, np.uint8) for x in more]
        self.ranks = [np.frombuffer(x, "<u8") for x in ranks]

    def _rank(self, level: int, at: int) -> int:
        """Ones of a level's bitmap before ``at``."""
        block = at // RANK_EVERY
        if block == len(self.ranks[level]):  # just past the last chunk, at a border
            block -= 1
        first = block * RANK_EVERY // 8
        count = int(self.ranks[level][block])
        count += int(np.bitwise_count(self.more[level][first:at // 8]).sum())
        if at % 8:
            count += int(self.more[level][at // 8] & ((1 << at % 8) - 1)).bit_count()
        return count

    def get(self, at: int) -> int:
        """The id at one place."""
        value, shift, level = 0, 0, 0
        while True:
            value |= int(self.levels[level][at]) << shift
            if not self.more[level][at // 8] >> at % 8 & 1:
                return value
            at, level, shift = self._rank(level, at), level + 1, shift + CHUNK_BITS

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to before ``stop``: a run of chunks on each level."""
        ids = np.zeros(stop - start, np.uint32)
        places, level = np.arange(stop - start), 0
        while len(places):
            ids[places] |= self.levels[level][start:stop].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            bits = np.unpackbits(self.more[level][start // 8:-(-stop // 8)], bitorder="little")
            places = places[bits[start % 8:start % 8 + stop - start].astype(bool)]
            if not len(places):
                break
            start = self._rank(level, start)
            stop, level = start + len(places), level + 1
        return ids


class WordEncoder:
    """Ids of whole texts under a tokenizer that drops white space, each different word of a call encoded once.

    Such a tokenizer's ids are those of the words between white space, one after the other. Words
    below U+0250 without special tokens are normalised and cut as the file says, by its own pattern, and
    their new parts go to its model many at a time, the ids told apart by the end-of-word mark; all others go
    through the whole tokenizer. Parts are fewer than words and are all that is remembered of the former.
    ``tests`` compares both with encoding whole texts.
    """

    def __init__(self, path: str, end_id: int | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import WhitespaceSplit

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.whole = Tokenizer.from_file(path)
        ends = config["model"]["end_of_word_suffix"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in config["model"]["merges"]]
        # Each part is asked for once, so the model need not remember any.
        self.model = Tokenizer(BPE(config["model"]["vocab"], merges, cache_capacity=0, end_of_word_suffix=ends))
        self.model.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith(ends)]] = True
        # White space to the tokenizer or to Unicode, but not in ASCII; texts that have any are encoded whole.
        self.other_spaces = "[\x1c-\x1f\x85\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]"
        # Words with other characters, or a special token, go through the whole tokenizer.
        self.odd = re.compile("[^\n\x20-\x7e\xa1-\u024f]|<\\|")
        self.cut = regex.compile(config["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + "|\\n")
        self.end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        self.known: dict[str, bytes] = {}  # of words that go through the whole tokenizer
        self.parts: dict[str, bytes] = {"\n": BREAK}
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.alphabet = np.zeros(256, "<u2")
        self.alphabet[printable], self.alphabet[others] = printable, 256 + np.arange(len(others))
        self.alphabet[32] = 32  # parts have no blank; it stands between them

    def _learn_parts(self, parts: list[str]) -> None:
        for start in range(0, len(parts), 1024):
            some = parts[start:start + 1024]
            mapped = self.alphabet[np.frombuffer(" ".join(some).encode(), np.uint8)].tobytes().decode("utf-16-le")
            ids = np.array(self.model.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, "<u4")
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            spans = map(slice, cuts[:-1], cuts[1:])
            self.parts.update(zip(some, map(ids.tobytes().__getitem__, spans), strict=True))

    def _plain(self, words: str) -> tuple[list[bytes], np.ndarray]:
        """Ids of words, given one a line, in an order of its own, and the place of each word's."""
        lower = unicodedata.normalize("NFC", words).lower().split("\n")
        # A word of letters is one part; all others are cut together, line breaks kept between them.
        one = list(map(str.isalpha, lower))
        letters, cut = list(compress(lower, one)), self.cut.findall("\n".join(compress(lower, map(not_, one))))
        if len(self.parts) > REMEMBERED:
            self.parts = {"\n": BREAK}
        parts = self.parts
        self._learn_parts(list({*letters, *cut}.difference(parts)))
        codes = list(map(parts.__getitem__, letters))
        if len(letters) < len(lower):
            codes += b"".join(map(parts.__getitem__, cut)).split(BREAK)
        alone = np.array(one)
        return codes, np.where(alone, np.cumsum(alone) - 1, len(letters) + np.cumsum(~alone) - 1)

    def _odd(self, words: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known = {w: self.known[w] for w in words if w in self.known}
        new = [w for w in words if w not in self.known]
        for start in range(0, len(new), 256):
            some = new[start:start + 256]
            for w, e in zip(some, self.whole.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, "<u4").tobytes()
        return list(map(self.known.__getitem__, words))

    def _codes(self, words: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Ids of different words, in an order of its own, and the place of each word's."""
        if not len(words):
            return [], np.zeros(0, np.int64)
        # One string for all: no word has a line break.
        joined = pc.binary_join(pa.LargeListArray.from_arrays([0, len(words)], words), pa.scalar("\n", words.type))[0].as_py()
        if not self.odd.search(joined):
            return self._plain(joined)
        names = joined.split("\n")
        odd = list(map(bool, map(self.odd.search, names)))
        rest, plain = self._odd(list(compress(names, odd))), "\n".join(compress(names, map(not_, odd)))
        codes, within = self._plain(plain) if len(rest) < len(names) else ([], np.zeros(0, np.int64))
        places = np.empty(len(names), np.int64)
        places[np.array(odd)] = len(codes) + np.arange(len(rest))
        places[~np.array(odd)] = within
        return codes + rest, places

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Ids of each text and the end id, as little-endian 32-bit integers."""
        texts = (pa.array(texts, pa.string()) if isinstance(texts, list) else texts).fill_null("")
        odd = pc.match_substring_regex(texts, self.other_spaces)
        split = pc.ascii_split_whitespace(pc.if_else(odd, "", texts))
        words = split.flatten().dictionary_encode()
        codes, order = self._codes(words.dictionary)
        # 64-bit places: the ids of a batch may take more bytes than its texts.
        codes = pa.array(codes, pa.large_binary()).take(pa.array(order[words.indices.to_numpy()]))
        places = np.frombuffer(codes.buffers()[1], "<i8", len(codes) + 1) if len(codes) else np.zeros(1, "<i8")
        cuts, data = places[split.offsets.to_numpy()].tolist(), memoryview(codes.buffers()[2] or b"")
        ids = [bytes(data[i:j]) + self.end for i, j in pairwise(cuts)]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            whole = self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids
            ids[i] = np.array(whole, "<u4").tobytes() + self.end
        return ids


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, cut to runs whose texts (the second column) have ``TEXT_BYTES`` at most, or to single rows."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + TEXT_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _encoder_of_this_process(path: str, end_id: int | None) -> WordEncoder:
    """Workers serve many tasks: what one has learnt about words is kept for the next."""
    kept = sys.modules.setdefault("shelfwise_worker", ModuleType("shelfwise_worker")).__dict__
    if (path, end_id) not in kept:
        kept[path, end_id] = WordEncoder(path, end_id)
    return kept[path, end_id]


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int | None,
                 shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the ids of every text of ``documents`` (``doc_id``, ``text``) below ``path``.

    Rows are in the order of ``doc_id``, NULL first, ties by the content's hash. ``path/shards`` has
    one row for each shard of about ``shard_tokens`` ids, made of whole texts: the texts' ids and
    sizes, and the codes of all tokens (see ``pack_codes``) in binary columns, so a reader fetches
    the levels it needs. ``path/index`` has the number of tokens before each shard. Files go through
    Spark's writer and may be in any store it reaches. A NULL or empty text has the end id alone.
    """
    rows = documents.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder_of_this_process(tokenizer, end_id)
        part = TaskContext.get().partitionId()
        names, sizes, codes, total, shard = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            levels, more, ranks = pack_codes(np.frombuffer(b"".join(codes), "<u4"))
            values = [part], [shard], [names], [sizes], [total], [levels], [more], [ranks]
            wide, parts = pa.list_(pa.int64()), pa.list_(pa.binary())
            kinds = pa.int32(), pa.int32(), wide, wide, pa.int64(), parts, parts, parts
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(values, kinds, strict=True)],
                names=["part", "shard", "doc_ids", "sizes", "n_tokens", "levels", "more", "ranks"],
            )

        for batch in batches:
            for some in _slices(batch):
                for name, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1)), strict=True):
                    names.append(name)
                    sizes.append(len(ids) // 4)
                    codes.append(ids)
                    total += len(ids) // 4
                    if total >= shard_tokens:
                        yield flush()
                        names, sizes, codes, total, shard = [], [], [], 0, shard + 1
        if names:
            yield flush()

    (
        rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
        .mapInArrow(run, SHARD).write.option("compression", "zstd").parquet(f"{path}/shards")
    )
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row of three numbers for each few million tokens.
    documents.sparkSession.read.parquet(f"{path}/shards").select(
        "part", "shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start")
    ).write.parquet(f"{path}/index")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (tokens before it) and ``tokens`` (ids as little-endian 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                reader = TokenReader(*[row[n].as_py() for n in ("levels", "more", "ranks")])
                sizes = row["sizes"].values.to_numpy()
                ends = np.cumsum(sizes)
                for low in range(0, len(sizes), 1024):
                    own = slice(low, low + 1024)
                    first = int(ends[low] - sizes[low])
                    codes = reader.slice(first, int(ends[own][-1])).astype("<u4").tobytes()
                    cuts = (4 * (np.concatenate(([first], ends[own])) - first)).tolist()
                    ids = [codes[i:j] for i, j in pairwise(cuts)]
                    yield pa.RecordBatch.from_arrays(
                        [row["doc_ids"].values[own], pa.array(row["start"].as_py() + ends[own] - sizes[own]),
                         pa.array(ids, pa.binary())],
                        names=["doc_id", "start", "tokens"],
                    )

    index = spark.read.parquet(f"{path}/index")
    shards = spark.read.schema(SHARD).parquet(f"{path}/shards")
    return shards.join(index, ["part", "shard"]).select(
        "doc_ids", "sizes", "levels", "more", "ranks", "start"
    ).mapInArrow(run, "doc_id long, start long, tokens binary")
