"""The five stages of the pipeline on a small table, each against brute force on what the stage before kept."""

import re
import zlib
from collections import Counter

import pytest
import xxhash

import corpus_pipeline
from shelfwise.llm.storage import stored

FOLDER = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def kept(spark):
    """The rows each stage was given and what it returned."""
    docs, found = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, FOLDER), name)
        found.append((name, [r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()]))
    return {name: (before, after) for name, before, after in found}


def test_the_stages_in_their_order(kept):
    assert list(kept) == ["quality_rules", "simhash_neardup", "benchmark_decontamination", "source_mixing", "token_ids"]
    columns = {"doc_id", "text", "lang", "source", "n_chars"}
    for name, (before, after) in kept.items():
        assert after and (name == "token_ids" or set(after[0]) == columns), name
    # A stage drops or repeats rows and changes none.
    for name in list(kept)[:4]:
        before, after = kept[name]
        assert {repr(r) for r in after} <= {repr(r) for r in before}


def test_quality_rejects_what_the_base_fails(kept):
    before, after = kept["quality_rules"]
    ids = {r["doc_id"] for r in after}
    for r in before:
        words = SPACE.findall(r["text"] or "")
        seen = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
        again = {k for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for k in range(i, i + 3)}
        if len(words) < 50 or 100 * len(again) > 50 * len(words):
            assert r["doc_id"] not in ids
    assert len(after) > 0.2 * len(before)


def fingerprint(text):
    words = SPACE.findall(lower(text))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_one_document_of_each_group_stays(kept):
    before, after = kept["simhash_neardup"]
    ids = sorted(r["doc_id"] for r in before)
    fp = {r["doc_id"]: fingerprint(r["text"]) for r in before}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (fp[i] ^ fp[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert sorted(r["doc_id"] for r in after) == [i for i in ids if find(i) == i]


def test_documents_with_a_benchmark_window_go(spark, kept):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))

    windows = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        found = words(r.text)
        n = min(10, len(found))
        windows |= {tuple(found[i:i + n]) for i in range(len(found) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}
    before, after = kept["benchmark_decontamination"]
    clean = [r["doc_id"] for r in before
             if not any(tuple(ws[i:i + n]) in windows for ws in [words(r["text"])] for n in sizes for i in range(len(ws) - n + 1))]
    assert sorted(r["doc_id"] for r in after) == sorted(clean) and len(clean) < len(before)


def test_each_source_comes_near_its_target(kept):
    before, after = kept["source_mixing"]
    size = {r["doc_id"]: len(SPACE.findall(r["text"] or "")) for r in before}
    sources = sorted({r["source"] for r in before if r["source"] is not None}) + [None] * any(r["source"] is None for r in before)
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    held = {s: sum(size[r["doc_id"]] for r in before if r["source"] == s) for s in sources}
    target, free, left = {}, set(sources), float(sum(held.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s for s in free if share[s] > 3 * held[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * held[s]
            left -= target[s]
        free -= over
    taken = Counter()
    for r in after:
        taken[r["source"]] += size[r["doc_id"]]
    assert max(Counter(r["doc_id"] for r in after).values()) <= 3
    for s in sources:
        assert abs(taken[s] - target[s]) <= min(size[r["doc_id"]] for r in before if r["source"] == s) + 1, s


def test_ids_are_those_of_the_tokenizer(kept):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    before, after = kept["token_ids"]
    start, wanted = 0, []
    for r in sorted(before, key=lambda r: r["doc_id"]):
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        wanted.append((r["doc_id"], start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in after) == wanted


def test_an_empty_table_passes_all_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), name)
        assert docs.count() == 0, name
