"""Quality rules that vote or abstain, weighed by expectation-maximisation."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.words import settled, split_words, window_hashes

def _repeated_words(ordered: str) -> Column:
    """Words in a window of three that is found twice: their windows lie side by side once sorted.

    ``ordered`` holds the windows as (hash, place), sorted, or nothing if all windows differ.
    """
    twice = F.filter(ordered, lambda g, i: (
        (g["h"] == F.get(ordered, i - 1)["h"]) | (g["h"] == F.get(ordered, i + 1)["h"])
    ).eqNullSafe(True))
    places = F.array_sort(F.transform(twice, lambda g: g["at"]))
    # Each window covers its words up to the next such window, three at most.
    return F.element_at(F.transform(F.array(places), lambda p: F.aggregate(
        F.transform(p, lambda at, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - at, F.lit(3)))),
        F.lit(0), lambda a, b: a + b,
    )), 1).cast("long")


def text_statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all columns as they were) and the counts the rules look at.

    ``n_words``; ``word_chars`` (code points in words); ``n_symbols`` (characters of ``#*$%&|<>``);
    ``n_lines`` (lines with a word); ``n_dup_lines`` (those equal to an earlier line);
    ``n_repeat_words`` (words in three-word windows found twice or more in the text);
    ``n_symbol_runs`` (runs of two symbols or more); ``n_bare_symbols`` (symbols between blanks);
    ``n_capitals`` (runs of two or more of A-Z); ``n_marks`` (``!``); ``n_stops`` (words that end a sentence);
    ``base_failed`` (fewer than 50 words, or more than half of them repeated). A NULL or empty text has
    zeros, repeated rows are each counted, an empty table gives none, and all other columns lie in ``row``, so no name
    clashes. Windows are compared by 64-bit hashes, within a text only; a text is counted whole in one row's expressions.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    cut = documents.select(
        F.struct("*").alias("row"), body.alias("body"), split_words(body).alias("words"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    hashed = cut.select("*", window_hashes("words", 3).alias("hashes"))
    ordered = hashed.select(
        "*", F.when(
            F.size(F.array_distinct("hashes")) < F.size("hashes"),
            F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,at:int>>")).alias("ordered"),
    )
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.char_length(F.array_join("words", "")),
        "n_symbols": F.regexp_count("body", F.lit(r"[#*$%&|<>]")),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": _repeated_words("ordered"),
        "n_symbol_runs": F.regexp_count("body", F.lit(r"[#*$%&|<>]{2,}")),
        "n_bare_symbols": F.regexp_count("body", F.lit(r" [#*$%&|<>] ")),
        "n_capitals": F.regexp_count("body", F.lit(r"[A-Z]{2,}")),
        "n_marks": F.char_length("body") - F.char_length(F.replace("body", F.lit("!"), F.lit(""))),
        "n_stops": F.size(F.filter("words", lambda w: w.endswith(".") | w.endswith("?") | w.endswith("!"))),
    }
    # Settled, so that a filter on the counts does not have them counted again.
    counted = settled(ordered.select("row", *[c.cast("long").alias(n) for n, c in counts.items()]))
    return counted.withColumn(
        "base_failed",
        (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(good, 1).when(bad, -1).otherwise(0).cast("int")


def rule_votes() -> dict[str, Column]:
    """Each rule on the statistics: 1 for a good text, -1 for a bad one, 0 if it abstains.

    A share between the two bounds of a rule, or of nothing, gets no vote.
    """
    words = F.col("n_words")

    def share(count: str, low: float, high: float) -> Column:
        """Few of them among the words are good, many are bad."""
        return _vote((words > 0) & (F.col(count) < low * words), F.col(count) > high * words)

    return {
        "length": _vote(words >= 80, words < 50),
        "word_length": _vote(
            (words > 0) & F.col("word_chars").between(3 * words, 9 * words),
            (words > 0) & ~F.col("word_chars").between(2 * words, 14 * words),
        ),
        "symbols": share("n_symbols", 0.02, 0.1),
        "symbol_runs": share("n_symbol_runs", 0.02, 0.1),
        "bare_symbols": share("n_bare_symbols", 0.02, 0.1),
        "repeats": share("n_repeat_words", 0.1, 0.3),
        "lines": _vote(
            (F.col("n_lines") >= 2) & (10 * F.col("n_dup_lines") < F.col("n_lines")),
            10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        ),
        "capitals": share("n_capitals", 0.1, 0.3),
        "marks": share("n_marks", 0.02, 0.1),
        "sentences": _vote(
            (words > 0) & F.col("n_stops").between(0.01 * words, 0.35 * words),
            (words >= 50) & (200 * F.col("n_stops") < words),
        ),
    }


@dataclass(frozen=True)
class LabelModel:
    """Share of good texts, and for each rule the chance of a good vote on a good and on a bad text."""

    share: float
    on_good: dict[str, float]
    on_bad: dict[str, float]

    def numbers(self) -> list[float]:
        return [self.share, *self.on_good.values(), *self.on_bad.values()]

    def weights(self) -> tuple[float, dict[str, dict[int, float]]]:
        """Log odds before any vote, and what a vote of each rule adds to them."""
        return math.log(self.share / (1 - self.share)), {
            r: {1: math.log(g / self.on_bad[r]), -1: math.log((1 - g) / (1 - self.on_bad[r]))}
            for r, g in self.on_good.items()
        }

    def probability(self, votes: dict[str, int]) -> float:
        odds, weights = self.weights()
        odds += sum(weights[r][v] for r, v in votes.items() if v)
        return 1 / (1 + math.exp(-odds))

    def posterior(self, votes: dict[str, Column]) -> Column:
        """Probability that a text is good, given the votes of the rules that do not abstain."""
        start, weights = self.weights()
        odds = F.lit(start)
        for rule, vote in votes.items():
            odds = odds + F.when(vote > 0, weights[rule][1]).when(vote < 0, weights[rule][-1]).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def vote_patterns(statistics: DataFrame) -> DataFrame:
    """How often each combination of votes occurs: at most three to the number of rules."""
    votes = rule_votes()
    return statistics.select(*[v.alias(n) for n, v in votes.items()]).groupBy(*votes).agg(
        F.count("*").alias("texts")
    )


#: What is believed before a text is seen: share of good texts, chances of a good vote on either kind.
#: A bad text breaks some rules only, so the rest still speak well of it. The beliefs count as this many
#: texts, so they fade as texts are seen; they tell which of the two kinds found is the good one.
START = (0.8, 0.99, 0.6)
BELIEF_TEXTS = 100
#: No rule is trusted more than this: one vote alone does not settle what nine others deny.
MOST_SURE = 0.99


def _accuracies(good: tuple[float, float], bad: tuple[float, float]) -> tuple[float, float]:
    """Chances of a good vote on good and on bad texts, from (good votes, bad votes) on either kind.

    A good vote never speaks against a text: where the votes say so, the rule tells nothing and both are equal.
    """

    def chance(votes: tuple[float, float], start: float) -> float:
        seen = (votes[0] + BELIEF_TEXTS * start) / (votes[0] + votes[1] + BELIEF_TEXTS)
        return min(MOST_SURE, max(1 - MOST_SURE, seen))

    on_good, on_bad = chance(good, START[1]), chance(bad, START[2])
    if on_good < on_bad:
        on_good = on_bad = chance((good[0] + bad[0], good[1] + bad[1]), START[1])
    return on_good, on_bad


def fit_label_model(patterns: DataFrame, rounds: int = 500, tolerance: float = 1e-9) -> LabelModel:
    """Estimate the share of good texts and the rules' accuracies from the votes alone.

    Texts are counted by pattern in Spark; the patterns, at most three to the number of rules however
    many texts there are, come to the driver, where the rounds of expectation and maximisation are
    plain sums. With no texts the starting beliefs are returned. Equal counts give equal models.
    """
    rules = [c for c in patterns.columns if c != "texts"]
    share, on_good, on_bad = START
    model = LabelModel(share, dict.fromkeys(rules, on_good), dict.fromkeys(rules, on_bad))
    seen = sorted((tuple(r[c] for c in rules), r["texts"]) for r in patterns.collect())
    for _ in range(rounds if seen else 0):
        good_texts = bad_texts = 0.0
        votes = {r: {1: [0.0, 0.0], -1: [0.0, 0.0]} for r in rules}  # by vote: on good, on bad texts
        for pattern, n in seen:
            good = n * model.probability(dict(zip(rules, pattern, strict=True)))
            good_texts += good
            bad_texts += n - good
            for rule, vote in zip(rules, pattern, strict=True):
                if vote:
                    votes[rule][vote][0] += good
                    votes[rule][vote][1] += n - good
        chances = {r: _accuracies((v[1][0], v[-1][0]), (v[1][1], v[-1][1])) for r, v in votes.items()}
        new = LabelModel(
            (good_texts + BELIEF_TEXTS * share) / (good_texts + bad_texts + BELIEF_TEXTS),
            {r: c[0] for r, c in chances.items()}, {r: c[1] for r, c in chances.items()},
        )
        moved = max(abs(a - b) for a, b in zip(new.numbers(), model.numbers(), strict=True))
        model = new
        if moved < tolerance:
            break
    return model


def judge_quality(statistics: DataFrame, model: LabelModel, threshold: float = 0.5) -> DataFrame:
    """``statistics`` with the ``posterior`` and ``kept``: not ``base_failed``, and probably good."""
    return statistics.withColumn("posterior", model.posterior(rule_votes())).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)
    )
