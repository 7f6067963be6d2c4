"""One query for each operator over its whole table, beside the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import ctw, decontaminate, html_text, lexical_search, licenses, mixing, prefix_trie, quality, simhash, substrings, token_store, toxicity, url_filter
from shelfwise.llm.storage import stored
from shelfwise.llm.words import split_words
from shelfwise.sources.scratch import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

#: The fixed rules of the URL query.
URL_RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of every document the mix takes."""
    sized = _table(spark, folder, "documents").select("doc_id", "source", "text")
    # Counted before the rows are dealt out, so that no text is.
    counted = sized.select("doc_id", "source", F.xxhash64("text").alias("text"), F.size(split_words(F.col("text"))).alias("size"))
    return mixing.mix_sources(counted, F.col("size")).select(
        "row.doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken")
    )


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Probabilities and verdicts of every document, under a chain fitted on the labels.

    The labels tell whether a text is toxic and whether it is junk: the chain asks first whether it is
    toxic, then whether it is toxic junk.
    """
    documents = _table(spark, folder, "documents")
    labels = _table(spark, folder, "labels").select(
        "doc_id", "toxic", (F.col("toxic") * (1 - F.col("quality"))).alias("toxic_junk")
    )
    chain = toxicity.fit_chain(documents, labels, ["toxic", "toxic_junk"])
    return toxicity.score_toxicity(documents, chain)


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The licence families whose notices every document has, by name."""
    documents = _table(spark, folder, "documents")
    found = licenses.scan_licenses(documents, licenses.fit_classifier(documents))
    return found.select(
        "doc_id", F.size("notices").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct("notices.family")), ",").alias("families"),
    )


def op3_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids, written in the library's format and read back from it."""
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    token_store.write_tokens(
        _table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2
    )
    return token_store.read_tokens(spark, path).select(
        "doc_id", "start", F.expr("length(tokens) div 4").alias("n_tokens"), F.crc32("tokens").alias("ids_crc32")
    )


def op5_simhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicate_classes(_table(spark, folder, "documents")).select(
        "doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id"
    )


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What every document loses and keeps when repeated passages go."""
    kept = substrings.remove_repeats(_table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return kept.select(
        "doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept"), 256).alias("kept_sha256")
    )


def op7_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Code length of every document, beside its probability by word frequencies."""
    return ctw.score_texts(_table(spark, folder, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """What of the benchmark occurs in every document."""
    found = decontaminate.report_contamination(
        _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    )
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), "contaminated",
    )


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on the URL of every page."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = _table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every document; the counts are stored once and fitted and judged from there."""
    counted = stored(quality.text_statistics(_table(spark, folder, "documents").select("doc_id", "text"))
                     .withColumn("doc_id", F.col("row.doc_id")).drop("row"), "statistics")
    model = quality.fit_label_model(stored(quality.vote_patterns(counted), "patterns"))
    return quality.judge_quality(counted, model).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical_search.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op12_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract_text(_table(spark, folder, "pages"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations."""
    return prefix_trie.prefix_trie(prefix_trie.rebuilt_conversations(_table(spark, folder, "conversations")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_source_mixing, op2_toxicity, op3_token_ids, op4_license_scan, op5_simhash_neardup, op6_substring_dedup, op7_lm_scoring, op8_benchmark_decontamination, op9_url_filter, op10_quality_rules,
        op11_lexical_search, op12_html_extraction, op13_prefix_trie,
    )
}

ORACLES: dict[str, str] = {
    "op6_substring_dedup": r"""
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
        row_number() OVER () AS r
    FROM documents),
p AS (
    SELECT r, pos, array_to_string(words[pos:pos + 34], ' ') AS gram
    FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS pos FROM d WHERE len(words) >= 35)),
h AS (SELECT r, pos FROM p QUALIFY count(*) OVER (PARTITION BY gram) > 1),
g AS (SELECT r, list(DISTINCT k) AS gone FROM (SELECT r, unnest(range(pos, pos + 35)) AS k FROM h) GROUP BY r),
k AS (
    SELECT d.r, string_agg(words[d.i], ' ' ORDER BY d.i) AS kept
    FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM d) d LEFT JOIN
        (SELECT r, unnest(gone) AS i, true AS x FROM g) x ON d.r = x.r AND d.i = x.i
    WHERE x.i IS NULL GROUP BY d.r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (r) LEFT JOIN k USING (r)
""",
    "op8_benchmark_decontamination": r"""
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words,
        row_number() OVER () AS r
    FROM documents),
b AS (
    SELECT item_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
    FROM benchmark),
g AS (
    SELECT DISTINCT item_id, least(len(words), 10) AS size,
        unnest(list_transform(range(1, len(words) - least(len(words), 10) + 2),
            lambda i: array_to_string(words[i:i + least(len(words), 10) - 1], ' '))) AS gram
    FROM b WHERE len(words) > 0),
s AS (SELECT DISTINCT size FROM g),
p AS (
    SELECT r, size, unnest(range(1, len(words) - size + 2)) AS pos, words FROM d, s WHERE len(words) >= size),
h AS (
    SELECT r, pos, g.size, item_id
    FROM (SELECT r, size, pos, array_to_string(words[pos:pos + size - 1], ' ') AS gram FROM p) q
    JOIN g ON q.gram = g.gram AND q.size = g.size),
c AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(pos, pos + size)) AS k FROM h) GROUP BY r),
i AS (
    SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
    FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
    n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN i USING (r)
""",
    "op9_url_filter": r"""
WITH u AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages),
p AS (
    SELECT page_id, row_number() OVER () AS r,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM u),
rules(h, q, said) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
    SELECT r, h || q AS rule, said FROM p JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
    QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(h || q) DESC, length(h) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(said, 'allow') AS verdict FROM p LEFT JOIN best USING (r)
""",
    "op11_lexical_search": r"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents),
s AS (SELECT count(*) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM d WHERE len(terms) > 0),
i AS (
    SELECT DISTINCT q, item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT *, row_number() OVER () AS q FROM benchmark)),
c AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d)
    WHERE term IN (SELECT term FROM i) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM c, s GROUP BY term, n),
m AS (SELECT r, doc_id, 10 + (90 * len(terms) * n) // l AS m FROM d, s),
z AS (
    SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
    FROM i JOIN c USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM z WHERE score > 0 QUALIFY rank <= 10
""",
    "op13_prefix_trie": r"""
WITH t AS (
    SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS n,
        substr(sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS d
    FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'d': d, 'n': n} ORDER BY turn NULLS FIRST, d) AS own FROM t GROUP BY conv_id),
h AS (
    SELECT conv_id, own, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
            string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [unicode(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 9 AS head
    FROM o),
r AS (
    SELECT h.conv_id, list_concat(coalesce(b.own, [])[1:head], h.own[head + 1:]) AS seq
    FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (
    SELECT conv_id, len(seq) AS l, unnest(range(0, len(seq) + 1)) AS d, seq FROM r),
k AS (
    SELECT conv_id, l, d, array_to_string(list_transform(seq[1:d], lambda x: x.d), '') AS k,
        CASE WHEN d > 0 THEN seq[d].n ELSE 0 END AS n
    FROM p),
n AS (
    SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(n) AS saved,
        coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE l = d), '') AS ends
    FROM k GROUP BY k, d),
c AS (SELECT substr(k, 1, 32 * (d - 1)::INT) AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
u AS (
    SELECT substr(k, 1, 32 * i::INT) AS k, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved) AS saved_tokens
    FROM (SELECT n.k, n.saved, c.k IS NULL AS leaf, unnest(range(0, d + 1)) AS i FROM n LEFT JOIN c USING (k)) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
    CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n LEFT JOIN c USING (k) JOIN u USING (k) LEFT JOIN n up ON n.d > 0 AND up.k = substr(n.k, 1, 32 * (n.d - 1)::INT)
""",
}
