"""Ranked search against a plain loop over all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from shelfwise.llm import lexical_search as lex
from shelfwise.llm.queries import QUERIES

DOCS = "doc_id bigint, text string, item_id string, rank int, n bigint, score string, terms string"
ITEMS = "item_id string, text string, doc_id int, term string, df int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(documents, items, k=10):
    """(item_id, rank, doc_id, score) of every item row."""
    held = [(d, Counter(terms(t))) for d, t in documents if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    found = []
    for item, text in items:
        scored = []
        for d, c in held:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(terms(text)) if c[t]
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        found += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(found, key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def drawn(seed):
    draw = random.Random(seed)
    words = ["Alpha", "bETA", "gamma", "ÉTÉ", "été", "x1", "日本", "the", "the", "a_b", "z\x00z", "Straße", "İ"]

    def text(n):
        return "".join(draw.choice(words) + draw.choice([" ", "\n", ",", "\t", "__", " "]) for _ in range(n))

    documents = [(i, text(draw.choice([0, 1, 3, 30]))) for i in range(400)]
    copies = [(1_000 + i, "gamma gamma copy") for i in draw.sample(range(600), 600)]
    odd = [(None, "gamma the"), (7, None), (7, "alpha"), (7, "alpha"), (8, ""), (9, "..."), (10, "w " * 2_000_000 + "tail")]
    items = [(str(i), text(draw.choice([1, 4, 20]))) for i in range(12)]
    items += [(None, "gamma"), ("0", "copy"), ("0", "copy"), ("e", ""), ("n", None), ("u", "unheard of"), ("t", "tail w")]
    return documents + copies + odd, items


@pytest.mark.parametrize("block, items_per_tile, terms_per_tile, rows", [(1 << 20, 256, 2048, 512), (60, 3, 2, 17)])
def test_search(spark, monkeypatch, block, items_per_tile, terms_per_tile, rows):
    monkeypatch.setattr(lex, "ITEMS_PER_TILE", items_per_tile)
    monkeypatch.setattr(lex, "TERMS_PER_TILE", terms_per_tile)
    documents, items = drawn(rows)
    d = spark.createDataFrame([(i, t, "k", 1, 1, "s", "t") for i, t in documents], DOCS).repartition(4)
    i = spark.createDataFrame([(i, t, 1, "t", 1) for i, t in items], ITEMS).repartition(2)
    assert collected(lex.search(d, i, block_bytes=block)) == brute(documents, items)


def test_text_ids_are_ranked_as_text(spark):
    d = spark.createDataFrame([(i, "same text") for i in ["b", "é", "a", "B", None, "10", "9"]], "doc_id string, text string")
    i = spark.createDataFrame([(1, "text")], "item_id int, text string")
    assert [r.doc_id for r in lex.search(d, i, k=4).orderBy("rank").collect()] == ["10", "9", "B", "a"]


def test_empty_sides(spark):
    d, i = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", "gamma", 1, "t", 1)], ITEMS)
    assert lex.search(d, i).collect() == []
    assert lex.search(spark.createDataFrame([(1, "gamma", "k", 1, 1, "s", "t")], DOCS), i.limit(0)).collect() == []


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lex, "PIECE_BYTES", 5)
    for text in ("", "abc", "abcdefgh ijk, l", "  a  b      cdefghijkl  ", "é" * 20 + " b"):
        assert [t.decode() for part in lex.terms_of(text.encode()) for t in part] == terms(text)


def test_sums_stay_exact():
    weight = np.full(10_000, 3_000_000)  # far heavier than a weight can be
    tiles = lex.cut_tiles([np.arange(10_000)], weight)
    assert sum(len(t.terms) for t in tiles) == 10_000
    assert all(int(t.weights.sum()) * lex.MOST_IMPACT < 2**53 for t in tiles)


def test_the_query(spark):
    folder = "/root/testdata/sf0.001"
    documents = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert collected(QUERIES["op11_lexical_search"](spark, folder)) == brute(documents, items)
