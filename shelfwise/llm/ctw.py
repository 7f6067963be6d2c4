"""Context-tree weighting: the code length of texts under a mixture over all context depths."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.chunks import body_of, each_chunk, pack_texts
from shelfwise.llm.storage import one_row_at_a_time, stored

DEPTH = 4
CHUNK_BYTES = 8 << 20
END = 10  # the byte that ends a text, and the context its first byte is read in


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after moving the argument up by eight."""
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(shift)


def kt_log_probability(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov estimate of a sequence with so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - math.log(math.pi)


class _Level:
    """The nodes of one depth: for each context of ``depth`` bytes and each bit of the byte that follows.

    ``key`` is the context, nearest byte first, and the byte, as one integer, ascending; ``n`` its count.
    For bit j, ``node[j]`` is each key's node (context and the j bits before), ``ones`` and ``zeros`` the
    node's counts, ``weighted`` the log of its weighted probability and ``trust`` the odds of its own
    estimate against its children's.
    """

    def __init__(self, key: np.ndarray, n: np.ndarray) -> None:
        self.key, self.n = key, n
        self.node, self.p, self.estimate, self.weighted, self.trust = [], [], [], [], []
        for bit in range(8):
            prefix = key >> (8 - bit)
            new = np.ones(len(key), bool)
            new[1:] = prefix[1:] != prefix[:-1]
            node = np.cumsum(new) - 1
            one = (key >> (7 - bit)) & 1
            ones = np.bincount(node, n * one)
            zeros = np.bincount(node, n * (1 - one))
            self.node.append(node)
            self.p.append((ones + 0.5) / (ones + zeros + 1))
            self.estimate.append(kt_log_probability(zeros, ones))

    def weigh(self, children: _Level | None, up: np.ndarray | None) -> None:
        """Mix each node's estimate with its children's; ``up`` is the place here of each child's key."""
        for bit in range(8):
            own = self.estimate[bit]
            if children is None:
                self.weighted.append(own)
                self.trust.append(np.zeros_like(own))
                continue
            # Every child node counts once, by the first of its keys.
            first = np.flatnonzero(np.diff(children.node[bit], prepend=-1))
            below = np.bincount(self.node[bit][up[first]], children.weighted[bit], minlength=len(own))
            self.weighted.append(np.logaddexp(own, below) - math.log(2))
            self.trust.append(np.exp(np.clip(own - below, -700, 700)))


def _levels(key: np.ndarray, n: np.ndarray, depth: int, least: int) -> list[tuple[_Level, np.ndarray | None]]:
    """Levels from ``depth`` down to ``least``; with each the place there of the keys of the level below."""
    levels = [(_Level(key, n), None)]
    for _ in range(depth - least):
        deeper = levels[-1][0]
        shorter = (deeper.key >> 16 << 8) | (deeper.key & 255)
        keys, up = np.unique(shorter, return_inverse=True)
        levels.append((_Level(keys, np.bincount(up, deeper.n)), up))
    children = None
    for level, up in levels:
        level.weigh(children, up)
        children = level
    return levels


def _bits(levels, top: dict[int, tuple[float, float]] | None) -> np.ndarray:
    """Log probability of each key of the deepest level: eight mixed bits.

    ``top`` has, for each bit prefix (with a leading one), the root's chance of a one and its trust; without
    it the last level is the root.
    """
    deepest = levels[0][0]
    total = np.zeros(len(deepest.key))
    places = [np.arange(len(deepest.key))]
    for _, up in levels[1:]:
        places.append(up[places[-1]])
    byte = deepest.key & 255
    for bit in range(8):
        mixed = None
        for (level, _), place in zip(levels, places, strict=True):
            node = level.node[bit][place]
            own, trust = level.p[bit][node], level.trust[bit][node]
            mixed = own if mixed is None else (trust * own + mixed) / (trust + 1)
        if top is not None:
            prefix = (1 << bit) | (byte >> (8 - bit))
            p, trust = (np.array([top[x][k] for x in range(256)])[prefix] for k in (0, 1))
            mixed = (trust * p + mixed) / (trust + 1)
        one = (byte >> (7 - bit)) & 1
        total += np.log(np.where(one == 1, mixed, 1 - mixed))
    return total


def root_trust(branches: DataFrame) -> dict[int, tuple[float, float]]:
    """The root's nodes from the sums of their children: at most 255 rows in the driver."""
    sums = branches.groupBy("prefix").agg(
        F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below")
    ).collect()
    top = dict.fromkeys(range(256), (0.5, 1.0))
    for r in sums:
        own = kt_log_probability(np.array([r["zeros"]]), np.array([r["ones"]]))[0]
        top[r["prefix"]] = (r["ones"] + 0.5) / (r["zeros"] + r["ones"] + 1), math.exp(max(-700.0, min(700.0, own - r["below"])))
    return top


def _grams(body: bytes, depth: int) -> np.ndarray:
    """For every byte, the bytes before it, nearest first, and the byte itself, as one integer.

    The context of a text's first bytes is filled up with the end of a text.
    """
    a = np.frombuffer(bytes([END] * depth) + body, np.uint8).astype(np.int64)
    n = len(body)

    def grams(at: np.ndarray | slice, fresh: int) -> np.ndarray:
        """At these places, of which ``fresh`` bytes of context belong to the text."""
        key = np.zeros(1, np.int64)
        for back in range(1, depth + 1):
            key = key << 8 | (a[depth - back:][:n][at] if back <= fresh else END)
        return key << 8 | a[depth:][at]

    key = grams(slice(None), depth)
    begins = np.concatenate(([0], np.flatnonzero(a[depth:-1] == END) + 1))
    ends = np.concatenate((begins[1:], [n]))
    for fresh in range(depth):
        at = (begins + fresh)[begins + fresh < ends]
        key[at] = grams(at, fresh)
    return key


#: Bytes of a chunk's texts whose contexts are written out at a time.
BLOCK_BYTES = 1 << 20


def _blocks(lines: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of lines of about ``BLOCK_BYTES``; a text reads nothing of the one before."""
    start, size = 0, 0
    for i, line in enumerate(lines):
        size += len(line) + 1
        if size >= BLOCK_BYTES or i == len(lines) - 1:
            yield start, i + 1
            start, size = i + 1, 0


def _body(lines: list[bytes]) -> bytes:
    return b"\n".join(lines) + b"\n"


#: Bytes of a tree of grams; costs of grams that need more are searched for.
TREE_BYTES = 96 << 20


class _Costs:
    """What grams cost, found by a walk down a tree of their bytes.

    Bytes are ranked among those that occur. A node of some bytes has a row with a place for each rank, where the node of
    one byte more stands, and the rows of whole contexts have the costs: space is for nodes by ranks, not for all pairs of
    a beginning and an end.
    """

    def __init__(self, known: np.ndarray, values: np.ndarray, depth: int) -> None:
        order = np.argsort(known)
        known, self.depth = known[order], depth
        seen = np.zeros(256, bool)
        seen[END] = True
        for back in range(depth + 1):
            seen[known >> (8 * back) & 255] = True
        self.rank = (np.cumsum(seen) - 1).astype(np.int32)
        self.wide, self.steps = int(seen.sum()), []
        nodes = [1] + [1 + np.count_nonzero(np.diff(known >> (8 * back))) for back in range(depth, 0, -1)]
        self.sorted = None
        if 4 * self.wide * sum(nodes) > TREE_BYTES:
            self.sorted = known, values[order]
            return
        node = np.zeros(len(known), np.int64)
        for back in range(depth, 0, -1):
            prefix = known >> (8 * back)
            child = np.cumsum(np.diff(prefix, prepend=prefix[:1]) != 0)
            step = np.zeros(nodes[depth - back] * self.wide, np.int32)
            step[node * self.wide + self.rank[prefix & 255]] = child
            self.steps.append(step)
            node = child
        self.last = np.zeros(nodes[depth] * self.wide, np.float32)
        self.last[node * self.wide + self.rank[known & 255]] = values[order]

    def of(self, body: bytes) -> np.ndarray:
        """The cost of every byte of the texts, as ``_grams`` has them."""
        if self.sorted:
            known, values = self.sorted
            return values[np.searchsorted(known, _grams(body, self.depth))]
        n, end = len(body), self.rank[END]
        a = self.rank[np.frombuffer(bytes([END] * self.depth) + body, np.uint8)]
        begins = np.concatenate(([0], np.flatnonzero(a[self.depth:-1] == end) + 1))
        node = np.zeros(n, np.intp)
        for back, step in enumerate(self.steps, 1):
            context = a[self.depth - back:][:n].copy()
            for fresh in range(back - 1):  # so far back lies another text
                context[begins[begins + fresh < n] + fresh] = end
            node *= self.wide
            node += context
            node = step.take(node).astype(np.intp)
        node *= self.wide
        node += a[self.depth:]
        return self.last.take(node)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([p[1] for p in parts])).astype(np.int64)


def _chunk_counts(depth: int):
    """Different grams and words of a chunk, and how often its training texts have them.

    A gram is told by its number, a word by its bytes; an empty word stands for the end of a text.
    """

    def work(row: dict) -> Iterator[list]:
        lines, held = body_of(row).split(b"\n")[:-1], np.array(row["flags"].as_py(), bool)
        parts, words, others = [], Counter(), set()
        for start, stop in _blocks(lines):
            some, out = lines[start:stop], held[start:stop]
            every = _grams(_body(some), depth)
            train = np.repeat(~out, [len(x) + 1 for x in some])
            parts.append(np.unique(every[train], return_counts=True))
            unseen = np.unique(every[~train])
            parts.append((unseen, np.zeros(len(unseen), np.int64)))
            for line, is_out in zip(some, out.tolist(), strict=True):
                (others if is_out else words).update([*line.split(), b""])
        grams, seen = _summed(parts)
        others = [w for w in others if w not in words]
        n, m = len(grams), len(words) + len(others)
        times = np.concatenate((seen, np.fromiter(words.values(), np.int64, len(words)), np.zeros(len(others), np.int64)))
        yield [
            pa.array(np.full(n + m, row["chunk"].as_py())),
            pa.concat_arrays([pa.array(grams), pa.nulls(m, pa.int64())]),
            pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([*words, *others], pa.binary())]),
            pa.array(times),
        ]

    return each_chunk(work, ["chunk", "gram", "word", "n"])


def _branch(depth: int):
    """Sums of the tree below one nearest byte, for the root."""

    def work(table: pa.Table) -> pa.Table:
        key, n = _sorted(table)
        level = _levels(key, n, depth, 1)[-1][0]
        prefix, zeros, ones, weighted = [], [], [], []
        for bit in range(8):
            first = np.flatnonzero(np.diff(level.node[bit], prepend=-1))
            prefix.append((1 << bit) | (level.key[first] & 255) >> (8 - bit))
            one = (level.key >> (7 - bit)) & 1
            ones.append(np.bincount(level.node[bit], level.n * one))
            zeros.append(np.bincount(level.node[bit], level.n * (1 - one)))
            weighted.append(level.weighted[bit])
        return pa.table({
            "prefix": np.concatenate(prefix).astype(np.int32), "zeros": np.concatenate(zeros),
            "ones": np.concatenate(ones), "weighted": np.concatenate(weighted),
        })

    return work


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    key, n = table.column("gram").to_numpy(), table.column("n").to_numpy().astype(float)
    order = np.argsort(key)
    return key[order], n[order]


def _code_lengths(depth: int, top: dict[int, tuple[float, float]]):
    def work(table: pa.Table) -> pa.Table:
        key, n = _sorted(table)
        cost = _bits(_levels(key, n, depth, 1), top) / math.log(10)
        return pa.table({"gram": key, "cost": cost.astype(np.float32)})

    return work


def _scores(depth: int, total: int, distinct: int):
    unknown = math.log10(0.5 / (total + 0.5 * (distinct + 1)))

    def work(row: dict) -> Iterator[list]:
        lines = body_of(row).split(b"\n")[:-1]
        words, costs = row["words"].values, row["grams"].values
        logs = dict(zip(
            words.field("word").to_pylist(),
            np.log10((words.field("n").to_numpy() + 0.5) / (total + 0.5 * (distinct + 1))).tolist(),
            strict=True,
        )) if words is not None else {}
        table = _Costs(costs.field("gram").to_numpy(), costs.field("cost").to_numpy(), depth)
        sizes = np.array([len(x) + 1 for x in lines])
        score = np.zeros(len(lines))
        for start, stop in _blocks(lines):
            own = sizes[start:stop]
            each = table.of(_body(lines[start:stop]))
            score[start:stop] = np.add.reduceat(each, np.cumsum(own) - own, dtype=np.float64)
        base, found, tokens = [], [], []
        for line in lines:
            parts = [logs.get(w) for w in (*line.split(), b"")]
            known = [x for x in parts if x is not None]
            tokens.append(len(parts))
            found.append(len(known))
            base.append(math.fsum(known) + (len(parts) - len(known)) * unknown)
        yield [
            row["ids"].values, row["flags"].values, pa.array(tokens, pa.int64()), pa.array(found, pa.int64()),
            pa.array(np.full(len(lines), total)), pa.array(base, pa.float64()), pa.array(score),
            pa.array(sizes, pa.int64()),
        ]

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"]
    return each_chunk(work, names)


def score_texts(documents: DataFrame, depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Scores of every row under models learnt from the rows that are not held out.

    ``held_out``: the remainder of the CRC of the id's text by five is one (never for a NULL id). A text is
    its words between ASCII white space, A-Z lower-cased, joined by a blank, and one end. ``base_score``
    is its log10 probability under the words' smoothed frequencies, ``score`` under context-tree weighting of
    its bytes: each byte is eight binary choices, each choice has a node for every context of up to ``depth``
    bytes before it, and the Krichevsky-Trofimov estimates of all depths are mixed by how well they
    code the training texts. ``-score / n_bytes`` is the code length per byte. Also ``n_tokens`` (words and end),
    ``n_known`` (seen in training) and ``train_tokens``. A NULL or empty text is an end alone; repeated
    rows are each scored and each learnt from; with nothing to learn from every choice is even.

    Texts are packed into stored chunks. A chunk tells its different grams (``depth`` bytes and the next one)
    and words with their counts; they are summed in Spark, before the shuffle too. All grams of a nearest
    byte make one branch of the tree, whose size is bounded by the alphabet and the depth, not by the
    rows. Code lengths and counts return to the chunks by joins on gram and word that adaptive execution
    broadcasts if they are small and splits where a gram is in every chunk.
    """
    held = (F.crc32(F.col("doc_id").cast("string")) % 5 == 1).eqNullSafe(True)
    chunks = pack_texts(documents.select("doc_id", "text", held.alias("flag")), "chunks", lower=True, chunk_bytes=chunk_bytes)
    spark = documents.sparkSession
    with one_row_at_a_time(spark):
        counts = stored(
            chunks.select("chunk", "flags", "body").mapInArrow(
                _chunk_counts(depth), "chunk long, gram long, word binary, n long"
            ), "counts",
        )
    grams = stored(
        counts.filter("gram is not null").groupBy("gram").agg(F.sum("n").alias("n"))
        .withColumn("near", F.shiftrightunsigned("gram", 8 * depth)), "grams",
    )
    words = stored(
        counts.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0"), "words"
    )
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    branches = grams.groupBy("near").applyInArrow(
        _branch(depth), "prefix int, zeros double, ones double, weighted double"
    )
    top = root_trust(branches)
    costs = stored(grams.groupBy("near").applyInArrow(_code_lengths(depth, top), "gram long, cost float"), "costs")
    by_gram = stored(
        counts.filter("gram is not null").select("chunk", "gram").join(costs, "gram").groupBy("chunk")
        .agg(F.collect_list(F.struct("gram", "cost")).alias("grams")), "by_gram",
    )
    by_word = stored(
        counts.filter("word is not null").select("chunk", "word").join(words, "word").groupBy("chunk")
        .agg(F.collect_list(F.struct("word", "n")).alias("words")), "by_word",
    )
    scores = (
        chunks.join(by_gram, "chunk").join(by_word, "chunk", "left")
        .select("ids", "flags", "body", "grams", "words")
        .mapInArrow(
            _scores(depth, total, distinct),
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
            "base_score double, score double, n_bytes long",
        )
    )
    with one_row_at_a_time(spark):
        return stored(scores, "scores")
