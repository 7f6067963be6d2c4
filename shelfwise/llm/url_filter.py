"""Verdicts on URLs: a blocked Bloom filter of the listed URLs, then an exact join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A block is eight 64-bit words with one bit of a key in each, at 16 bits a listed URL on average.
WORDS = 8
KEYS_PER_BLOCK = 32


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))


def _block(host: Column, path: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), host, path), F.lit(blocks))


def _masks(host: Column, path: Column) -> list[Column]:
    """The bit of a key in each word of its block, from six bits of one hash each."""
    bits = F.xxhash64(F.lit(23), host, path)
    one = F.lit(1).cast("long")
    return [
        F.call_function("shiftleft", one, F.shiftrightunsigned(bits, 6 * i).bitwiseAND(63).cast("int"))
        for i in range(WORDS)
    ]


def build_bloom(rules: DataFrame, blocks: int) -> DataFrame:
    """Blocks of the filter: ``block`` and the words ``w0`` to ``w7``; only blocks with a key."""
    host, path = F.col("host"), F.col("path")
    keyed = rules.select(
        _block(host, path, blocks).alias("block"),
        *[m.alias(f"m{i}") for i, m in enumerate(_masks(host, path))],
    )
    return keyed.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` of each URL.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and all subdomains where
    the URL's path starts with the rule's path. The rule with the longest host and path together
    wins, then the longer host; of rules listed twice the smallest verdict stands. URLs that no rule
    fits get no rule and the default verdict.

    Each different host and path is looked at once. Its suffixes of the host and beginnings of the
    path are the URLs that may be listed; those the Bloom filter passes meet the rules in an exact
    join, which removes false positives. Neither join forces a broadcast: small lists are broadcast
    by their size, long ones are shuffled and hot hosts split by adaptive execution. The numbers of labels and the path lengths
    that occur in the rules come to the driver, at most as many as the longest host has labels and the longest path
    characters; only suffixes and beginnings of these sizes are looked at, so a host of very many labels costs no more.

    A NULL URL, or one without ``://``, has an empty host and path and no rule. Rules with a NULL are
    left out. Repeated rows stay. Columns of ``pages`` with one of the four names are replaced.
    """
    rules = rules.dropna(subset=["host", "path", "verdict"]).groupBy("host", "path").agg(
        F.min("verdict").alias("verdict")
    )
    def labels(host: str) -> Column:
        return F.char_length(host) - F.char_length(F.replace(F.col(host), F.lit("."), F.lit(""))) + 1

    listed, lengths, sizes = rules.agg(
        F.count("*"), F.collect_set(F.char_length("path")), F.collect_set(labels("host"))
    ).first()
    names = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in names]
    split = pages.select(
        F.struct(*kept).alias("row"),
        F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"),
        F.coalesce(path_of(F.col(url)), F.lit("")).alias("path"),
    )
    if not listed:
        return split.select(
            "row.*", "host", "path", F.lit(None).cast("string").alias("rule"),
            F.lit(default).alias("verdict"),
        )
    suffixes = F.filter(F.array(*[
        F.when(labels("host") >= n, F.substring_index("host", ".", -n)) for n in sorted(sizes)
    ]), F.isnotnull)
    beginnings = F.transform(
        F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: n <= F.char_length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    blocks = -(-listed // KEYS_PER_BLOCK)
    likely = (
        split.filter(F.col("host") != "").select("host", "path").distinct()
        .withColumn("s_host", F.explode(suffixes))
        .withColumn("s_path", F.explode(beginnings))
        .withColumn("block", _block(F.col("s_host"), F.col("s_path"), blocks))
        .join(build_bloom(rules, blocks), "block")
    )
    for i, mask in enumerate(_masks(F.col("s_host"), F.col("s_path"))):
        likely = likely.filter(F.col(f"w{i}").bitwiseAND(mask) != 0)
    exact = rules.select(
        F.col("host").alias("s_host"), F.col("path").alias("s_path"), F.col("verdict").alias("said")
    )
    best = (
        likely.select("host", "path", "s_host", "s_path").join(exact, ["s_host", "s_path"])
        .groupBy("host", "path")
        .agg(F.max(F.struct(
            (F.char_length("s_host") + F.char_length("s_path")).alias("total"),
            F.char_length("s_host").alias("part"),
            F.concat("s_host", "s_path").alias("rule"), F.col("said"),
        )).alias("best"))
    )
    return split.join(best, ["host", "path"], "left").select(
        "row.*", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.said", F.lit(default)).alias("verdict"),
    )
