"""The trie of conversation prefixes, built from sorted neighbours by union-find.

Conversations stand in the order of their turns' digests, dealt to tasks by range. Two neighbours share as many
turns as their longest common prefix, an edge of that depth. A task takes its edges from the deepest
to the shallowest and merges the components at their ends; what merges at a depth is a node with branches there, and the
turns between two merges are nodes with one child. What contains a task's first or last
conversation may go on in the neighbouring task: those nodes, no more than the turns of these two conversations, are left
open with what the task knows of them. In the next round they alone are the task's forest, forests of
neighbouring tasks are merged by the same steps, and so on until one is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.storage import stored

DIGEST = 16
#: Turns in one range; tasks are as many as the session's shuffle partitions at least.
TURNS_PER_RANGE = 2_000_000
#: Neighbouring forests merged at once.
FAN_IN = 64
ENDS_PER_PIECE = 1 << 16
_ROWS_OUT = 1 << 14
_NODE, _OPEN, _ENDS = 0, 1, 2

_FIELDS = {
    "kind": ("int", pa.int32()), "key": ("binary", pa.binary()), "conv_id": ("bigint", pa.int64()),
    "depth": ("bigint", pa.int64()), "parent_conv_id": ("bigint", pa.int64()), "parent_key": ("binary", pa.binary()),
    "n_convs": ("bigint", pa.int64()), "n_children": ("bigint", pa.int64()), "n_leaves": ("bigint", pa.int64()),
    "saved_tokens": ("bigint", pa.int64()), "ends_sha256": ("string", pa.string()), "has_ends": ("boolean", pa.bool_()),
    "size": ("bigint", pa.int64()), "part": ("bigint", pa.int64()), "place": ("int", pa.int32()), "ends": ("string", pa.string()),
}
_SCHEMA = ", ".join(f"{n} {t}" for n, (t, _) in _FIELDS.items())
_AT = {n: i for i, n in enumerate(_FIELDS)}


# ------------------------------------------------------------------------------------ conversations


def turn_digest(role: Column, text: Column) -> Column:
    """Hexadecimal digest of a turn, the first 16 bytes of the SHA-256 of role and text; NULL counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)


def ordered_turns(conversations: DataFrame, near: Column | None = None) -> DataFrame:
    """(conv_id, near, turns): each conversation's (digest, bytes of the text), in order.

    Turns are ordered by ``turn``, NULL first, then by digest; equal rows stay apart. Only digests are gathered, not texts.
    ``near`` names what conversations are dealt by; those of one value meet in one task.
    """
    near = F.col("conv_id") if near is None else near
    turns = conversations.filter("conv_id is not null").select(
        near.alias("near"), "conv_id", F.struct(
            "turn", turn_digest(F.col("role"), F.col("text")).alias("digest"),
            F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"),
        ).alias("one"),
    )
    gathered = turns.repartition("near").groupBy("near", "conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    return gathered.withColumn("turns", F.transform("turns", lambda t: F.struct(t["digest"], t["size"])))


def rebuilt_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the first h turns of the conversation ``conv_id - conv_id % 5``, then the own ones after the first h.

    h is ``crc32(conv_id) % 9``. A conversation that is absent lends no turns.
    """
    base = F.col("conv_id") - F.col("conv_id") % 5
    gathered = ordered_turns(conversations, base)
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    # At most nine conversations, with ids next to each other, are near; they stand together already.
    lender = F.first(F.when(F.col("conv_id") == F.col("near"), F.slice("turns", 1, 8)), ignorenulls=True)
    lent = F.coalesce(lender.over(Window.partitionBy("near")), F.slice("turns", 1, 0))
    return gathered.select(
        "conv_id", F.concat(F.slice(lent, F.lit(1), head), F.slice("turns", head + 1, F.size("turns") + 1)).alias("turns")
    )


# ------------------------------------------------------------------------------------------- forest


@dataclass(slots=True)
class Known:
    """What is known of a node besides its open children."""

    convs: int = 0
    least: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: list = field(default_factory=list)
    has_ends: bool = False

    def add(self, other: Known) -> None:
        self.convs += other.convs
        if other.least is not None and (self.least is None or other.least < self.least):
            self.least = other.least
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends += other.ends
        self.has_ends |= other.has_ends


@dataclass(slots=True)
class Item:
    """A sequence in its place: a conversation, or the first or last one of a forest with what hangs on its prefixes."""

    sizes: np.ndarray
    known: dict[int, Known]

    @property
    def length(self) -> int:
        return len(self.sizes)


def merge_forest(
    items: list[Item], edges: np.ndarray, names: Callable[[int], list[bytes]], part: int, named: bool, last_round: bool,
) -> Iterator[list]:
    """Rows of all nodes of sorted ``items``, whose neighbours i - 1 and i share ``edges[i]`` turns.

    Nodes that contain the first or last item stay open unless it is the ``last_round``. ``names(i)`` are the keys of the
    prefixes of item i; all rows bear them if ``named``, else the open ones only.
    """
    n = len(items)
    root, last = list(range(n)), list(range(n))
    depth = [i.length for i in items]
    known = [i.known.pop(i.length, None) or Known() for i in items]
    hung = [[i] if item.known else [] for i, item in enumerate(items)]
    waiting: list[list[list]] = [[] for _ in items]  # rows whose parent is this component's node
    cached: dict[int, list[bytes]] = {}

    def key(i: int, at: int) -> bytes:
        if i not in cached:
            cached[i] = names(i)
        return cached[i][at]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def climb(x: int, to: int) -> Iterator[list]:
        """Rows of the nodes of component x that lie deeper than ``to``, where it then stands."""
        first, sizes = x == 0, items[x].sizes
        is_open = not last_round and (first or last[x] == n - 1)
        side = 0 if first else last[x]
        while depth[x] > to:
            d, k = depth[x], known[x]
            size = int(sizes[d - 1]) if d else 0
            row = [None] * len(_FIELDS)
            row[_AT["depth"]], row[_AT["size"]], row[_AT["part"]] = d, size, part
            row[_AT["conv_id"]], row[_AT["n_convs"]], row[_AT["n_children"]] = k.least, k.convs, k.children
            if is_open:
                row[_AT["kind"]], row[_AT["key"]], row[_AT["place"]] = _OPEN, key(side, d), int(not first)
                row[_AT["n_leaves"]], row[_AT["saved_tokens"]], row[_AT["has_ends"]] = k.leaves, k.saved, k.has_ends
                for child in waiting[x]:
                    child[_AT["parent_key"]] = row[_AT["key"]]
                for at in range(0, len(k.ends), ENDS_PER_PIECE):
                    yield _piece(row[_AT["key"]], part, at // ENDS_PER_PIECE, k.ends[at:at + ENDS_PER_PIECE])
                waiting[x], known[x] = [], Known()
            else:
                saved, leaves = k.saved + (k.convs - 1) * size, k.leaves or 1
                row[_AT["kind"]], row[_AT["n_leaves"]], row[_AT["saved_tokens"]] = _NODE, leaves, saved
                row[_AT["has_ends"]] = k.has_ends
                if k.ends or not k.has_ends:  # else they are in the pieces
                    row[_AT["ends_sha256"]] = hashlib.sha256(",".join(map(str, k.ends)).encode()).hexdigest()
                if named:
                    row[_AT["key"]] = key(x, d)
                for child in waiting[x]:
                    child[_AT["parent_conv_id"]] = k.least
                waiting[x] = [row]
                known[x] = Known(k.convs, k.least, 1, leaves, saved)
            yield row
            depth[x] = d - 1
            for i in hung[x]:
                if more := items[i].known.pop(d - 1, None):
                    known[x].add(more)

    for i in np.argsort(-edges[1:], kind="stable") + 1:
        i, shared = int(i), int(edges[i])
        a, b = find(i - 1), i
        yield from climb(a, shared)
        yield from climb(b, shared)
        root[b], last[a] = a, last[b]
        known[a].add(known[b])
        waiting[a] += waiting[b]
        hung[a] += hung[b]
        known[b], waiting[b], hung[b] = Known(), [], []
    yield from climb(0, -1)
    if n > 1 and not last_round:  # the last item's prefixes that the first one has too: known there, named here
        for d in range(int(edges[1:].min()), -1, -1):
            row = [None] * len(_FIELDS)
            row[_AT["kind"]], row[_AT["key"]], row[_AT["depth"]] = _OPEN, key(n - 1, d), d
            row[_AT["part"]], row[_AT["place"]], row[_AT["n_convs"]] = part, 1, 0
            row[_AT["size"]] = int(items[n - 1].sizes[d - 1]) if d else 0
            row[_AT["n_children"]] = row[_AT["n_leaves"]] = row[_AT["saved_tokens"]] = 0
            row[_AT["has_ends"]] = False
            yield row


def _piece(key: bytes, part: int, place: int, ids: list[int]) -> list:
    row = [None] * len(_FIELDS)
    row[_AT["kind"]], row[_AT["key"]], row[_AT["part"]] = _ENDS, key, part
    row[_AT["place"]], row[_AT["ends"]] = place, ",".join(map(str, ids))
    return row


def _batches(rows: Iterable[list]) -> Iterator[pa.RecordBatch]:
    """Rows are given out at the end: a parent may be known later than its child."""
    rows = list(rows)
    for at in range(0, len(rows), _ROWS_OUT):
        columns = zip(*rows[at:at + _ROWS_OUT], strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS.values(), strict=True)], names=list(_FIELDS)
        )


def _shared_turns(a: bytes, b: bytes) -> int:
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // DIGEST
    differ = np.frombuffer(a, np.uint8, most) != np.frombuffer(b, np.uint8, most)
    return int(differ.argmax()) // DIGEST


def _prefix_names(sequence: bytes) -> list[bytes]:
    """A key of every prefix, from none to all turns."""
    state = hashlib.sha256(b"root")
    found = [state.digest()[:DIGEST]]
    for at in range(0, len(sequence), DIGEST):
        state.update(sequence[at:at + DIGEST])
        found.append(state.digest()[:DIGEST])
    return found


def _first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, items = [], []
    for batch in batches:
        ids, found, sizes = batch.columns
        flat, offsets = sizes.flatten().to_numpy(), sizes.offsets.to_numpy() - sizes.offsets[0].as_py()
        keys += found.to_pylist()
        for j, conv in enumerate(ids.to_pylist()):
            own = flat[offsets[j]:offsets[j + 1]]
            items.append(Item(own, {len(own): Known(1, conv, ends=[conv], has_ends=True)}))
    if not items:
        return
    edges = np.zeros(len(keys), np.int64)
    for i in range(1, len(keys)):
        edges[i] = _shared_turns(keys[i - 1], keys[i])
    part = TaskContext.get().partitionId()
    yield from _batches(merge_forest(items, edges, lambda i: _prefix_names(keys[i]), part, False, False))


def _later_round(fan_in: int, last_round: bool) -> Callable:
    def merge(table: pa.Table) -> pa.Table:
        columns = ["part", "place", "depth", "key", "size", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "has_ends"]
        table = table.sort_by([(c, "ascending") for c in columns[:3]])
        names: list[list[bytes]] = []
        sizes: list[list[int]] = []
        known: list[dict[int, Known]] = []
        before = None
        for part, place, depth, key, size, least, *counts, has_ends in zip(*(table[c].to_pylist() for c in columns), strict=True):
            if (part, place) != before:
                names.append([]), sizes.append([]), known.append({})
                before = part, place
            names[-1].append(key)
            if depth:
                sizes[-1].append(size)
            known[-1][depth] = Known(counts[0], least, counts[1], counts[2], counts[3], has_ends=has_ends)
        items = [Item(np.array(s, np.int64), k) for s, k in zip(sizes, known, strict=True)]
        edges = np.zeros(len(items), np.int64)
        for i in range(1, len(items)):
            edges[i] = sum(a == b for a, b in zip(names[i - 1], names[i])) - 1
        part = before[0] // fan_in
        return pa.Table.from_batches(list(_batches(merge_forest(items, edges, lambda i: names[i], part, True, last_round))))

    return merge


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of each key's pieces, which arrive in order; one piece is in memory, not a key's."""
    key, state, done = None, None, []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())], names=["key", "sha"]
        )

    for batch in batches:
        for this, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if this != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = this, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        if done:
            yield flush()
            done = []
    if key is not None:
        done.append((key, state.hexdigest()))
        yield flush()


def prefix_trie(sequences: DataFrame, ranges: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """One row for every distinct prefix of ``sequences`` (``conv_id``, ``turns`` of digest and size).

    ``conv_id`` (least member), ``depth``, ``parent_conv_id`` (NULL at the root), ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``. Turns with equal digests, 128 bits, count as equal. An empty table has no node, not
    even a root; a conversation without turns is a member of the root. Conversations with equal turns may be in many tasks. In
    memory are a range's digests, and of one conversation 20 bytes a turn however long it is.
    """
    spark = sequences.sparkSession
    flat = stored(sequences.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"),
        F.transform("turns", lambda t: t["size"].cast("bigint")).alias("sizes"),
    ), "sequences")
    if ranges is None:
        turns = flat.agg(F.sum(F.size("sizes"))).first()[0] or 0
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // TURNS_PER_RANGE))
    sorted_ = flat.repartitionByRange(ranges, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    rounds = [stored(sorted_.mapInArrow(_first_round, _SCHEMA), "forest")]
    pieces = rounds[0].filter(F.col("kind") == _ENDS).select("key", "part", "place", "ends")
    # A stage of the session may have more partitions than asked for.
    parts = (rounds[0].agg(F.max("part")).first()[0] or 0) + 1
    while True:
        group = F.floor(F.col("part") / fan_in).alias("group")
        left = rounds[-1].filter(F.col("kind") == _OPEN)
        parts = -(-parts // fan_in)
        rounds.append(stored(left.groupBy(group).applyInArrow(_later_round(fan_in, parts == 1), _SCHEMA), "forest"))
        if parts == 1:
            break
    nodes = [r.filter(F.col("kind") == _NODE) for r in rounds]
    inner, outer = nodes[0], nodes[1]
    for more in nodes[2:]:
        outer = outer.unionByName(more)
    hashed = pieces.repartition("key").sortWithinPartitions("key", "part", "place").select("key", "ends").mapInArrow(
        _hash_pieces, "key binary, sha string"
    )
    ended = F.col("has_ends")
    outer = stored(
        outer.filter(~ended).unionByName(outer.filter(ended).drop("ends_sha256").join(
            hashed.withColumnRenamed("sha", "ends_sha256"), "key")), "nodes",
    )
    parents = outer.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    every = inner.unionByName(outer)
    far = every.filter("parent_key is not null").join(parents, "parent_key").withColumn("parent_conv_id", F.col("parent")).drop("parent")
    return every.filter("parent_key is null").unionByName(far).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
