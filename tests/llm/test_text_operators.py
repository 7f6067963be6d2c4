"""Each operator against brute force, on texts with NULLs, ties, copies and clashing columns."""

import hashlib
import math
import random
import time
import tracemalloc
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from shelfwise.llm import (
    ctw, decontaminate, licenses, linear, mixing, quality, simhash, substrings, token_store, toxicity, url_filter,
)

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, key string, row int, "
          "words string, kept boolean, n_words int, size int")
draw = random.Random(3)
WORDS = ["alpha", "Beta", "gamma", "délta", "Épsilon", "zeta.", "eta", "theta!", "***", "|"]


def prose(n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


PASSAGE, LONG = prose(60), prose(9000)
TEXTS = [
    None, "", " \t\n", "a", "a b", prose(70), prose(70) + " " + PASSAGE, PASSAGE + "\x0b" + prose(20), LONG,
    LONG + " end", prose(300), "same line\nsame line\nother", "one " * 80, prose(40) + "\r\n\x1cx\u2003y",
]
ROWS = [(i, t, "en", [None, "s1", "s2", "é"][i % 4], 1, "k", 1, "w", True, 5, 6) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[5], ROWS[5], (None, TEXTS[5], None, None, None, None, None, None, None, None, None), (5, TEXTS[10], *ROWS[5][2:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def counted(rows):
    return Counter(map(repr, rows))


def test_substrings(docs, none):
    seen = Counter(tuple(words(t)[i:i + 35]) for _, t, *_ in ROWS for i in range(len(words(t)) - 34))
    wanted = []
    for i, t, *_ in ROWS:
        ws = words(t)
        gone = {k for a in range(len(ws) - 34) if seen[tuple(ws[a:a + 35])] > 1 for k in range(a, a + 35)}
        wanted.append((i, len(ws), b" ".join(w for k, w in enumerate(ws) if k not in gone).decode(), len(gone)))
    got = substrings.remove_repeats(docs, bucket_bytes=2000).collect()
    assert counted((r.doc_id, r.n_words, r.kept, sum(s.end - s.start for s in r.spans)) for r in got) == counted(wanted)
    assert substrings.remove_repeats(none).count() == 0


def test_simhash(docs, none):
    def plain(text):
        ws = (text or "").encode().lower().split()
        grams = [b" ".join(ws[i:i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    prints = [plain(r[1]) for r in ROWS]
    group = list(range(len(ROWS)))
    for _ in ROWS:
        for a in range(len(ROWS)):
            for b in range(len(ROWS)):
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    least = {g: min(r[0] for r, h in zip(ROWS, group) if h == g and r[0] is not None) for g in set(group)}
    wanted = counted((r[0], f"{p:016x}", least[g]) for r, p, g in zip(ROWS, prints, group))
    got = simhash.near_duplicate_classes(docs).select("doc_id", simhash.as_hex(F.col("fp")), "component_id")
    assert counted(tuple(r) for r in got.collect()) == wanted
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(least)
    assert simhash.near_duplicate_classes(none).count() == 0


def test_links_are_those_of_all_pairs_however_the_leaves_are_cut(spark):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, 60, np.uint64)
    near = [int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centre for a, b in rng.integers(0, 64, (20, 2))]
    fps = np.unique(np.array(near, np.uint64)).view(np.int64)
    pairs = [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps.view(np.uint64)[i] ^ fps.view(np.uint64)) <= 2)]
    wanted = simhash._spanning(len(fps), iter([(np.array([i]), np.array([j])) for i, j in pairs]))
    frame = spark.createDataFrame([(int(f),) for f in fps], "fp long").repartition(4)
    at = {int(f): i for i, f in enumerate(fps)}
    for leaf, block in ((64, 10**6), (10**6, 100)):
        links = simhash.find_links(frame, leaf_rows=leaf, block_rows=block).collect()
        edges = [(np.array([at[r.a]]), np.array([at[r.b]])) for r in links]
        assert (simhash._spanning(len(fps), iter(edges)) == wanted).all()


def test_decontamination(spark, docs, none):
    items = [(1, " ".join(PASSAGE.split()[5:20])), (2, "Alpha"), (3, None), (4, "***"), (5, "not there at all"), (None, "eta")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")

    def cut(text):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return "".join(c if c > "\x7f" or c.isalnum() else " " for c in lower).split(" ")

    wanted = []
    for i, t, *_ in ROWS:
        ws = [w for w in cut(t) if w]
        hit, found = set(), set()
        for name, text in items:
            own = [w for w in cut(text) if w]
            n = min(10, len(own))
            grams = {tuple(own[a:a + n]) for a in range(len(own) - n + 1)} if n else set()
            for a in range(len(ws) - n + 1 if n else 0):
                if tuple(ws[a:a + n]) in grams:
                    hit.update(range(a, a + n))
                    found.update([] if name is None else [name])
        wanted.append((i, len(ws), len(hit), sorted(found), bool(hit)))
    for limit in (10**6, 0):
        texts, hits = decontaminate.find_contamination(docs, benchmark, broadcast_windows=limit)
        assert texts.join(hits, "key").count() == sum(w[4] for w in wanted)
    got = decontaminate.report_contamination(docs, benchmark).collect()
    assert counted((r.doc_id, r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in got) == counted(wanted)
    clean = decontaminate.drop_contaminated(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == sum(not w[4] for w in wanted)
    assert decontaminate.report_contamination(none, benchmark).count() == 0
    assert not decontaminate.report_contamination(docs, benchmark.limit(0)).filter("contaminated").count()


def test_urls(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow"), ("b.org", "/", "block")]
    urls = [None, "", "no scheme", "http://X.NET/a", "http://example.net/en/1", "http://a.example.net/en", "http://net",
            "x://b.org/fr/?q", "x://anet/", "x://c.org/fr/#", "ftp://a.b.org/fr/z", "http://x.net/a"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id int, url string, host string, path string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for i, url in enumerate(urls):
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, path = rest[:end].lower(), rest[end:].split("?")[0].split("#")[0]
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, 0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best[2], best[3])
    empty = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_filter.judge_urls(pages, empty).filter("rule is null and verdict = 'allow'").count() == len(urls)


def test_quality_counts_and_model(docs, none):
    got = quality.text_statistics(docs).collect()
    for r in got:
        text = r["row"].text or ""
        ws = text.encode().split()
        grams = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
        often = Counter(grams)
        repeated = {k for i, g in enumerate(grams) if often[g] > 1 for k in range(i, i + 3)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        assert (r.n_words, r.n_repeat_words) == (len(ws), len(repeated))
        assert r.word_chars == sum(len(w.decode()) for w in ws)
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(ws) < 50 or 100 * len(repeated) > 50 * len(ws))
    assert quality.fit_label_model(quality.vote_patterns(quality.text_statistics(none))).share == quality.START[0]


def test_the_label_model_finds_junk_without_labels(spark):
    data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    counts = quality.text_statistics(data)
    judged = quality.judge_quality(counts, quality.fit_label_model(quality.vote_patterns(counts)))
    rows = judged.select("row.doc_id", "kept", "base_failed").join(labels, "doc_id").filter("not base_failed").collect()
    right = sum(r.kept == bool(r.quality) for r in rows)
    assert right >= 0.97 * len(rows)


def drawn_votes(spark, n, accuracies, share=0.9):
    """Counts of the votes of independent rules: expected numbers of ``n`` texts, by (good vote on good, on bad)."""
    rows = []
    for votes in product((1, -1), repeat=len(accuracies)):
        chance = [share, 1 - share]
        for vote, pair in zip(votes, accuracies):
            chance = [c * (p if vote > 0 else 1 - p) for c, p in zip(chance, pair)]
        rows.append((*votes, round(n * sum(chance))))
    return spark.createDataFrame(rows, ", ".join(f"r{i} int" for i in range(len(accuracies))) + ", texts bigint")


def test_a_useless_rule_loses_its_weight_as_texts_are_seen(spark):
    true = [(0.95, 0.2), (0.9, 0.3), (0.97, 0.4), (0.7, 0.7)]
    gaps = []
    for n in (200, 20_000, 2_000_000):
        model = quality.fit_label_model(drawn_votes(spark, n, true))
        gaps.append(abs(model.on_good["r3"] - model.on_bad["r3"]))
    assert gaps[0] > gaps[1] > gaps[2] and gaps[2] < 0.001
    assert all(abs(w) < 0.002 for w in model.weights()[1]["r3"].values())


def test_the_label_model_finds_the_accuracies_of_its_rules(spark):
    true = [(0.95, 0.2), (0.9, 0.3), (0.97, 0.4), (0.85, 0.5)]
    model = quality.fit_label_model(drawn_votes(spark, 2_000_000, true))
    assert model.share == pytest.approx(0.9, abs=0.01)
    for i, (good, bad) in enumerate(true):
        assert (model.on_good[f"r{i}"], model.on_bad[f"r{i}"]) == pytest.approx((good, bad), abs=0.01)


def test_a_good_vote_never_speaks_against_a_text(spark):
    model = quality.fit_label_model(drawn_votes(spark, 100_000, [(0.95, 0.2), (0.9, 0.3), (0.97, 0.4), (0.2, 0.9)]))
    assert all(model.on_good[r] >= model.on_bad[r] for r in model.on_good)
    assert model.weights()[1]["r3"] == {1: 0.0, -1: 0.0}


def test_mixing(docs, none):
    got = mixing.mix_sources(docs).collect()
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += len(words(r[1]))
    taken = Counter()
    for r in got:
        assert r["size"] == len(words(r["row"].text)) and r.source_size == sizes[r["row"].source] and 0 <= r.repeats <= 3
        taken[r["row"].source] += r.repeats * r["size"]
    targets = {r["row"].source: r.target for r in got}
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    assert all(targets[s] <= 3 * sizes[s] + 1e-9 for s in sizes)
    again = mixing.mix_sources(docs.repartition(2)).collect()
    assert counted((r["row"], r.repeats) for r in again) == counted((r["row"], r.repeats) for r in got)
    assert mixing.write_out(mixing.mix_sources(docs)).columns == docs.columns
    assert mixing.mix_sources(none).count() == 0
    for source, target in targets.items():
        # As near its target as whole passes and any choice of its texts come.
        passes, sums = int(target // sizes[source]), {0}
        for r in ROWS:
            if r[3] == source:
                sums |= {x + len(words(r[1])) for x in sums}
        budget = round(target - passes * sizes[source])
        assert abs(taken[source] - passes * sizes[source] - budget) == min(abs(x - budget) for x in sums)


def test_many_sources_are_numbered_by_code_point(spark):
    names = [f"host {i * 7919 % 1009}.é" for i in range(1009)] + ["Z", "a", "é", None]
    rows = spark.createDataFrame([(n, 5) for n in names], "source string, source_size bigint").repartition(7)
    wanted = {n: i % 3 + 1 for i, n in enumerate([*sorted(x for x in names if x is not None), None])}
    got = mixing.code_point_weights(rows).collect()
    assert len(got) == len(names) and {r.source: r.weight for r in got} == wanted
    assert mixing.code_point_weights(rows.limit(0)).count() == 0


def test_the_mix_is_drawn_by_all_columns(spark):
    rows = [(1, "a b c", "x" if i % 2 else "y", i, {"k": i}) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n int, m map<string,int>")
    runs = [sorted((r.n for r in mixing.write_out(mixing.mix_sources(docs.repartition(n))).collect())) for n in (1, 3, 5)]
    assert runs[0] == runs[1] == runs[2]



def test_closest_subset_is_that_of_all_subsets():
    rng = np.random.default_rng(0)
    for _ in range(200):
        sizes = np.unique(rng.integers(1, 30, 4))
        counts = rng.integers(0, 4, len(sizes))
        wanted = int(rng.integers(0, 90))
        sums = {0}
        for s, c in zip(sizes, counts):
            sums = {x + s * k for x in sums for k in range(c + 1)}
        best = min(abs(x - wanted) for x in sums)
        chosen = mixing._closest_subset(sizes, counts, wanted)
        assert abs(sum(s * n for s, n in chosen.items()) - wanted) == best
        assert all(n <= counts[list(sizes).index(s)] for s, n in chosen.items())


def test_codes_give_every_token(tmp_path, spark, docs, none):
    rng = np.random.default_rng(2)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = (rng.integers(0, 2**32, n, np.uint64) >> rng.integers(0, 32, n, np.uint64)).astype(np.uint32)
        reader = token_store.TokenReader(*token_store.pack_codes(ids))
        assert [reader.get(i) for i in range(n)] == ids.tolist()
        for a, b in rng.integers(0, n + 1, (40, 2)):
            assert (reader.slice(min(a, b), max(a, b)) == ids[min(a, b):max(a, b)]).all()
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    whole = tokenizers.Tokenizer.from_file(path)
    odd = ["a\x1cb", "Don't we'll 's", "日本 x", "<|endoftext|> a<|startoftext|>", "İ ΟΔΟΣ ΣΑΣ", "ﬁ é", "1234.5", "😀x", "\x00 \x7f", "ª º"]
    encoder = token_store.WordEncoder(path, 2)
    for text, codes in zip(odd, encoder.encode(odd)):
        assert np.frombuffer(codes, "<u4").tolist() == [*whole.encode(text, add_special_tokens=False).ids, 2]
    token_store.write_tokens(docs, str(tmp_path / "tokens"), path, 2, shard_tokens=1000)
    rows = sorted(token_store.read_tokens(spark, str(tmp_path / "tokens")).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0] + [len(r.tokens) // 4 for r in rows[:-1]]).tolist()
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    wanted = [(r[0], np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in ROWS]
    assert counted((r.doc_id, bytes(r.tokens)) for r in rows) == counted(wanted)
    token_store.write_tokens(none, str(tmp_path / "nothing"), path, 2)
    assert token_store.read_tokens(spark, str(tmp_path / "nothing")).count() == 0


def test_parts_are_encoded_once_and_words_not_remembered():
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    whole, encoder = tokenizers.Tokenizer.from_file(path), token_store.WordEncoder(path, 2)
    learnt = []
    learn = encoder._learn_parts
    encoder._learn_parts = lambda parts: (learnt.extend(parts), learn(parts))
    for texts in (
        ["Blanking blanking, (BLANKING) don't", None, ""], ["blanking’s", "“blanking”"], ["Blanking. a<|b 日本 İx, blanking!", "\n"], ["x"], [],
    ):
        got = [np.frombuffer(codes, "<u4").tolist() for codes in encoder.encode(texts)]
        assert got == [[*whole.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert learnt.count("blanking") == 1 and len(learnt) == len(set(learnt))
    assert set(encoder.known) == {"blanking’s", "“blanking”", "a<|b", "日本"}


def test_slices_follow_the_bytes_of_the_texts():
    def sizes(texts: list[str | None]) -> list[int]:
        columns = [pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())]
        batch = pa.RecordBatch.from_arrays(columns, names=["doc_id", "text"])
        slices = list(token_store._slices(batch))
        assert [i for s in slices for i in s.column(0).to_pylist()] == list(range(len(texts)))
        return [s.num_rows for s in slices]

    half = "x" * (token_store.TEXT_BYTES // 2)
    assert sizes([]) == [] and sizes(["a", None, ""] * 1500) == [4500]
    assert sizes([half, half, None, "a", 3 * half, "a", half, half]) == [3, 1, 1, 2, 1]


def test_context_tree_weighting_by_its_definition(spark):
    texts = [(i, draw.choice([None, "", "ab ba", "abab b", "Aab é", "b a b a b"])) for i in range(24)]
    depth = 2
    bodies = {i: b" ".join((t or "").encode().lower().split()) + b"\n" for i, t in texts}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in bodies}

    def events(body):
        padded = b"\n" * depth + body
        for k, byte in enumerate(body):
            context = bytes(reversed(padded[k:k + depth]))
            for bit in range(8):
                yield context, (bit, byte >> (8 - bit)), byte >> (7 - bit) & 1

    tally = Counter(e for i, b in bodies.items() if not held[i] for e in events(b))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def node(context, prefix):
        return [sum(n for (c, p, x), n in tally.items() if p == prefix and x == bit and c.startswith(context)) for bit in (0, 1)]

    letters = sorted({byte for body in bodies.values() for byte in body})

    def weighted(context, prefix):
        own = kt(*node(context, prefix))
        if len(context) == depth:
            return own
        below = sum(weighted(context + bytes([x]), prefix) for x in letters)
        return np.logaddexp(own, below) - math.log(2)

    def chance(context, prefix):
        zeros, ones = node(context, prefix)
        return (ones + 0.5) / (zeros + ones + 1)

    memo = {}

    def mixed(full, prefix):
        if (full, prefix) not in memo:
            p = chance(full, prefix)
            for d in range(depth - 1, -1, -1):
                own = kt(*node(full[:d], prefix))
                below = sum(weighted(full[:d] + bytes([x]), prefix) for x in letters)
                trust = math.exp(own - below)
                p = (trust * chance(full[:d], prefix) + p) / (trust + 1)
            memo[full, prefix] = p
        return memo[full, prefix]

    frame = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in ctw.score_texts(frame, depth, chunk_bytes=20).collect()}
    known = Counter(w for i, b in bodies.items() if not held[i] for w in [*b.split(), b""])
    total, distinct = sum(known.values()), len(known)
    for i, body in bodies.items():
        score = sum(math.log10(mixed(c, p) if x else 1 - mixed(c, p)) for c, p, x in events(body))
        base = sum(math.log10((known[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in [*body.split(), b""])
        assert got[i].score == pytest.approx(score, rel=1e-4) and got[i].base_score == pytest.approx(base)
        assert (got[i].held_out, got[i].train_tokens, got[i].n_tokens) == (held[i], total, len(body.split()) + 1)
    assert ctw.score_texts(frame.limit(0)).count() == 0


@pytest.mark.parametrize("letters", [80, 250])
def test_a_chunk_of_many_contexts_is_scored_in_little_memory(letters):
    """Space grows with the grams of a chunk, not with their beginnings times their ends; each gram has its own cost."""
    rng = np.random.default_rng(6)
    lines = [bytes(rng.integers(33, 33 + letters, 3000) % 256).replace(b"\n", b"") for _ in range(10)] + [b"", b"a", b"ab", b""]
    lines = [b" ".join(x.split()) for x in lines]
    grams = np.unique(ctw._grams(ctw._body(lines), 4))
    costs = -rng.random(len(grams)).astype(np.float32)
    of = dict(zip(grams.tolist(), costs.tolist(), strict=True))
    row = {
        "ids": pa.array([list(range(len(lines)))])[0], "flags": pa.array([[False] * len(lines)])[0],
        "body": pa.array([zstandard.compress(ctw._body(lines))], pa.binary())[0],
        "grams": pa.array([[{"gram": g, "cost": c} for g, c in of.items()]], pa.list_(pa.struct([("gram", pa.int64()), ("cost", pa.float32())])))[0],
        "words": pa.array([[{"word": b"a", "n": 1}]])[0],
    }
    batch = pa.RecordBatch.from_arrays([pa.array([v.as_py()], v.type) for v in row.values()], names=list(row))
    tracemalloc.start()
    found = next(ctw._scores(4, 10, 5)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160 << 20
    for line, score in zip(lines, found.column(6).to_pylist(), strict=True):
        assert score == pytest.approx(sum(of[g] for g in ctw._grams(ctw._body([line]), 4).tolist()), rel=1e-6)


def test_chunks_go_to_python_one_by_one(spark, docs, monkeypatch):
    taken, kept = spark.sparkContext.accumulator(0), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def count(work, names):
        def run(batches):
            for batch in batches:
                taken.add(batch.num_rows - 1)
                yield from each(iter([batch]))
        each = each_chunk(work, names)
        return run

    each_chunk = ctw.each_chunk
    monkeypatch.setattr(ctw, "each_chunk", count)
    assert ctw.score_texts(docs.coalesce(1), chunk_bytes=20).count() == len(ROWS)
    assert taken.value == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == kept


def test_scores_of_texts_with_gaps(docs):
    assert ctw.score_texts(docs).filter("score < 0 and n_tokens > 0").count() == len(ROWS)


def test_the_chain_on_texts_it_has_not_seen(spark, docs):
    data = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fitted = labels.filter("doc_id % 3 <> 0").select("doc_id", "toxic", (F.col("toxic") * (1 - F.col("quality"))).alias("toxic_junk"))
    chain = toxicity.fit_chain(data, fitted, ["toxic", "toxic_junk"])
    unseen = data.join(labels.filter("doc_id % 3 = 0"), "doc_id")
    rows = toxicity.score_toxicity(unseen.select("doc_id", "text"), chain).join(labels.withColumnRenamed("toxic", "truth"), "doc_id").collect()
    found = sum(r.toxic and r.truth for r in rows)
    assert found >= 0.9 * sum(r.truth for r in rows) and found >= 0.95 * sum(r.toxic for r in rows)
    assert toxicity.score_toxicity(docs, chain).count() == len(ROWS)
    nothing = toxicity.fit_chain(docs, fitted.limit(0), ["toxic"])
    assert toxicity.score_toxicity(docs, nothing).filter("toxic").count() == 0


def test_of_clashing_labels_the_least_counts(spark):
    texts = spark.createDataFrame([(i, f"plain words number {i % 9} " + ("vile " * (i % 2))) for i in range(200)], "doc_id bigint, text string")
    clean = [(i, i % 2) for i in range(200)]
    chains = [
        toxicity.fit_chain(texts, spark.createDataFrame(rows, "doc_id bigint, toxic int").coalesce(1), ["toxic"])
        for rows in (clean, clean + [(4, 1), (6, 1)], [(4, 1), (6, 1)] + clean)
    ]
    assert chains[0] == chains[1] == chains[2]
    rows = toxicity.score_toxicity(texts, chains[1]).collect()
    assert all(r.toxic == bool(r.doc_id % 2) for r in rows)
    assert toxicity.score_toxicity(texts.limit(0), chains[0]).collect() == []


def test_beginnings_of_words():
    assert toxicity.features_of("Stemmed stemma, stemX stemx! no") == {
        "stemmed", "stemma", "stemx", "no", "stemm*1", "stemm*2"}
    assert toxicity.features_of(None) == set()


def test_licences(spark, docs):
    lines = {
        "MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
        "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    }
    rows = [(i, f"{prose(30)}\n{line}\n{prose(30)}") for i, line in enumerate(lines.values())]
    ordinary = docs.select("doc_id", "text")
    classifier = licenses.fit_classifier(ordinary)
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string"), classifier).collect()
    assert {r.doc_id: [(n.place, n.family) for n in r.notices] for r in found} == {i: [(1, f)] for i, f in enumerate(lines)}
    assert licenses.scan_licenses(ordinary, classifier).filter(F.size("notices") > 0).count() == 0


def test_logistic_regression_separates():
    rows = linear.Rows([[0], [1], [0, 2], [1, 2]] * 20, 3)
    w, _, b = linear.fit_logistic(rows, np.zeros((80, 0)), np.array([1.0, 0, 1, 0] * 20), 1e-3)
    assert ((rows.dot(w) + b > 0) == (np.array([1, 0, 1, 0] * 20) > 0)).all() and abs(w[2]) < abs(w[0])


def test_kept_text_digest(docs):
    text = substrings.remove_repeats(docs).select(F.sha2(F.col("kept"), 256).alias("d"), "kept").first()
    assert text.d == hashlib.sha256(text.kept.encode()).hexdigest()


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""


def commented(text, mark):
    return "\n".join(f"{mark} {line}" for line in text.split("\n"))


def test_wrapped_licences(spark, docs):
    rows = [
        (0, f"Copyright (c) 2020 The Authors\n\n{MIT}\n\nThe above copyright notice", [(2, "MIT")]),
        (1, f"#!/bin/sh\n#\n{commented(GPL, '#')}\n#\necho", [(2, "GPL-3.0")]),
        (2, f"/*\n * Copyright 2020 The Authors\n *\n{commented(BSD, ' *')}\n */\n{prose(30)}", [(3, "BSD-3-Clause")]),
        # No line without words between notice and prose, and more prose than a window has.
        (3, f"{prose(200)}\n{GPL}\n{prose(200)}\n{commented(MIT, '//')}\n{prose(150)}", [(1, "GPL-3.0"), (6, "MIT")]),
        (4, f"{prose(67)}\n{prose(60)}\n{MIT}\n{GPL}", [(2, "MIT"), (8, "GPL-3.0")]),
    ]
    classifier = licenses.fit_classifier(docs.select("doc_id", "text"))
    texts = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    found = licenses.scan_licenses(texts, classifier).collect()
    assert {r.doc_id: [(n.place, n.family) for n in r.notices] for r in found} == {r[0]: r[2] for r in rows}


def test_unlisted_licences_are_unknown(spark, docs):
    texts = [
        "Licensed under CC BY-NC-SA 4.0.", "Licensed under the Academic Free License, version 3.0.",
        "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\n"
        "License as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
        "Permission to use, copy, modify and distribute this software and its documentation for any purpose is granted without fee.",
        "Copyright 2020 The Authors",
    ]
    classifier = licenses.fit_classifier(docs.select("doc_id", "text"))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: [n.family for n in r.notices] for r in licenses.scan_licenses(rows, classifier).collect()}
    assert found == {0: ["unknown"], 1: ["unknown"], 2: ["unknown"], 3: ["unknown"], 4: []}
    assert 0 < classifier.threshold < 1


def test_short_notices_tags_and_ordinary_prose(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {
        "The contract was granted by the city and the license of the driver was revoked without notice.": [],
        "The driver had no license and the software of the car was modified.": [],
        "Licensed under the MIT license.": ["MIT"],
        "This project is MIT licensed.": ["MIT"],
        "SPDX-License-Identifier: MIT": ["MIT"],
        "// SPDX-License-Identifier: GPL-2.0-only\nint main();": ["GPL-2.0"],
        "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND LicenseRef-x": ["MIT", "Apache-2.0", "unknown"],
        "SPDX-License-Identifier: GPL-3.0-or-later WITH Bison-exception-2.2": ["GPL-3.0"],
        "Released under the MIT License. See the file for details.": ["MIT"],
        "Distributed under the Boost Software License, Version 1.0. See the file for details.": ["BSL-1.0"],
        "SPDX-License-Identifier:": [],
    }
    classifier = licenses.fit_classifier(documents)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: [n.family for n in r.notices] for r in licenses.scan_licenses(rows, classifier).collect()}
    assert [found[i] for i in range(len(texts))] == list(texts.values())
    # The notices of the table: found and named where a text speaks of a licence, nothing elsewhere.
    spoken = F.lower("text").rlike("licens|permission is hereby")
    scanned = licenses.scan_licenses(documents, classifier).join(documents.select("doc_id", spoken.alias("spoken")), "doc_id")
    counts = scanned.agg(
        F.count_if("spoken"), F.count_if(F.col("spoken") & (F.size("notices") > 0)), F.count_if(~F.col("spoken") & (F.size("notices") > 0)),
        F.count_if(F.array_contains("notices.family", "unknown")),
    ).first()
    assert counts[1] >= 0.9 * counts[0] > 0 and counts[2] == counts[3] == 0


def test_the_licence_sample_below_its_bound(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "concat('word', id, ' common') as text")
    small = licenses.fit_classifier(rows, sample_paragraphs=100)
    assert licenses.fit_classifier(rows.repartition(5), sample_paragraphs=100) == small
    assert licenses.fit_classifier(rows.limit(0)).families == small.families


def test_the_chain_counts_a_repeated_document_once(spark):
    rows = [(i, f"{prose(20)} {'vile' if i % 3 == 0 else 'kind'}") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id bigint, toxic int")
    once, often = (spark.createDataFrame(r, "doc_id bigint, text string").repartition(3) for r in (rows, rows + rows[:1] * 300))
    assert toxicity.fit_chain(often, labels, ["toxic"]) == toxicity.fit_chain(once, labels, ["toxic"])


def test_hosts_of_very_many_labels(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("b.c.org", "/x", "allow"), ("odd..net", "/", "allow")], "host string, path string, verdict string")
    urls = ["http://" + "a." * 16_000 + "net/", "http://" + "." * 16_000 + "net/", "http://q.b.c.org/xy", "http://c.org/x", "http://odd..net/", "http://net"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    start = time.perf_counter()
    got = {r.page_id: r.rule for r in url_filter.judge_urls(pages, rules).select("page_id", "rule").collect()}
    assert got == {0: "net/", 1: "net/", 2: "b.c.org/x", 3: None, 4: "odd..net/", 5: None}
    assert time.perf_counter() - start < 30
    assert url_filter.judge_urls(pages.limit(0), rules).collect() == []
