"""The prefix trie against a trie of dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from shelfwise.llm import prefix_trie as trie
from shelfwise.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, turns int, path string, near string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    """Conversations as the query's contract rebuilds them; turns of one number are ordered by their digest."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(found)] for c, found in own.items()}
    result = {}
    for c, turns in own.items():
        head = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        result[c] = own.get(base, [])[:head] + turns[head:]
    return result


def brute(sequences):
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        size = len(node[-1][1].encode()) if node else 0
        saved[node] = sum(saved[k] for k in children[node]) + (len(members[node]) - 1) * size
    rows = []
    for node, found in members.items():
        ends = ",".join(str(c) for c in sorted(found) if len(sequences[c]) == len(node))
        rows.append((
            min(found), len(node), min(members[node[:-1]]) if node else None, len(found), len(children[node]),
            leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(rows, key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


def drawn(seed, conversations=120):
    draw = random.Random(seed)
    rows = []
    for c in range(-12, conversations):
        for turn in range(draw.choice([0, 1, 2, 3, 9, 14])):
            rows.append((c, turn, draw.choice(["user", "user", None]), draw.choice(["a", "é", "a", None])))
    copies = [(c, t, "user", f"common {t}") for c in range(500, 700) for t in range(10)]  # many equal ones
    spine = [(800 + n, t, "assistant", "x" * (t % 7)) for n in range(0, 60, 5) for t in range(n * 3)]  # each a prefix of the next
    odd = [(None, 1, "user", "nobody's"), (3, None, "user", "first"), (3, None, "user", "first"), (3, 1, None, None),
           (9, 1, "user", "same turn"), (9, 1, "user", "other"), (2**62, 5, "ab", "c"), (2**62 + 5, 5, "a", "bc"),
           (1001, 1, "user", "only turn"), (40, 99, "user", "long " * 200_000)]
    return rows + copies + spine + odd


@pytest.mark.parametrize("ranges, fan_in", [(1, 64), (3, 64), (9, 2), (40, 3)])
def test_same_nodes_however_it_is_cut(spark, ranges, fan_in):
    rows = drawn(ranges)
    table = spark.createDataFrame([(*r, 1, "p", "n") for r in rows], SCHEMA).repartition(5)
    got = trie.prefix_trie(trie.rebuilt_conversations(table), ranges, fan_in)
    assert collected(got) == brute(rebuilt(rows))


def test_without_rebuilding(spark):
    rows = [(c, t, "user", str(t % 2)) for c in range(30) for t in range(c % 7)]
    table = spark.createDataFrame([(*r, 1, "p", "n") for r in rows], SCHEMA)
    plain = defaultdict(list)
    for c, _t, role, text in rows:
        plain[c].append((role, text))
    assert collected(trie.prefix_trie(trie.ordered_turns(table), 4, 2)) == brute(plain)


def test_pieces_of_ends_are_hashed_in_order(spark, monkeypatch):
    rows = [(c, 0, "user", "same") for c in range(2_000, 2_900)]
    table = spark.createDataFrame([(*r, 1, "p", "n") for r in rows], SCHEMA)
    monkeypatch.setattr(trie, "ENDS_PER_PIECE", 7)
    sequences = {c: [("user", "same")] for c, *_ in rows}
    assert collected(trie.prefix_trie(trie.ordered_turns(table), 6, 2)) == brute(sequences)


def test_nothing_has_no_root(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert collected(trie.prefix_trie(trie.rebuilt_conversations(table))) == []
    only_nulls = spark.createDataFrame([(None, 1, "user", "x", 1, "p", "n")], SCHEMA)
    assert collected(trie.prefix_trie(trie.rebuilt_conversations(only_nulls))) == []


def test_turnless_conversations_belong_to_the_root(spark):
    # Conversation 1 has one turn and loses it to the base's head, which is absent.
    lost = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    table = spark.createDataFrame([(lost, 0, "user", "x", 1, "p", "n")], SCHEMA)
    root = trie.prefix_trie(trie.rebuilt_conversations(table)).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_leaves, r.ends_sha256) for r in root] == [
        (lost, 0, 1, 1, hashlib.sha256(str(lost).encode()).hexdigest())]


def test_the_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(QUERIES["op13_prefix_trie"](spark, folder)) == brute(rebuilt(rows))
