"""Toxicity by a chain of linear classifiers, each fed the probabilities of those before it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.linear import Rows, fit_logistic, sigmoid

#: Labelled rows the chain is fitted on at most, the least by a seeded hash of their id.
SAMPLE_ROWS = 12_000
FOLDS = 3
PENALTY = 2e-4
_WORD = re.compile(r"[^\W_]+")


#: Letters of a word's beginning, and up to how many different words of a beginning are told apart.
BEGINNING, MOST_ALIKE = 5, 3


def features_of(text: str | None) -> set[str]:
    """The different words of a text, and beginnings of words with the number of different words that begin so.

    A stem with many endings is met in new forms in new texts, and one such word says less than several.
    """
    words = set(_WORD.findall((text or "").lower()))
    alike = Counter(w[:BEGINNING] for w in words if len(w) > BEGINNING)
    return words | {f"{b}*{n}" for b, found in alike.items() for n in range(1, min(found, MOST_ALIKE) + 1)}


@dataclass(frozen=True)
class Chain:
    """For each category its features' weights, the weights of the earlier probabilities, and an intercept."""

    categories: list[str]
    weights: dict[str, tuple[float, ...]]
    earlier: list[list[float]]
    intercepts: list[float]
    thresholds: list[float]

    def probabilities(self, features: set[str]) -> list[float]:
        sums = list(self.intercepts)
        for w in features & self.weights.keys():
            for k, x in enumerate(self.weights[w]):
                sums[k] += x
        out: list[float] = []
        for k, z in enumerate(sums):
            z += sum(a * p for a, p in zip(self.earlier[k], out, strict=True))
            out.append(float(sigmoid(np.array(z))))
        return out


def _best_threshold(p: np.ndarray, wanted: np.ndarray) -> float:
    """Middle of the widest range of thresholds with the best F1 on out-of-fold probabilities."""
    grid = np.linspace(0.05, 0.95, 91)
    hit = np.array([((p >= t) & (wanted > 0)).sum() for t in grid])
    f1 = 2 * hit / np.maximum(1, np.array([(p >= t).sum() for t in grid]) + wanted.sum())
    return float(np.median(grid[f1 >= f1.max() - 1e-12]))


def _fit(categories: list[str], folds: int, penalty: float):
    def fit(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values(["doc_id", "text"], ignore_index=True)
        found = [features_of(t) for t in sample["text"]]
        often = Counter(w for ws in found for w in ws)
        vocabulary = sorted(w for w, n in often.items() if n >= 3)
        place = {w: i for i, w in enumerate(vocabulary)}
        rows = Rows([sorted(place[w] for w in ws if w in place) for ws in found], len(vocabulary))
        del found, often
        part = sample["fold"].to_numpy()
        earlier = np.zeros((len(sample), 0))
        out = []
        for k, name in enumerate(categories):
            wanted = sample[name].to_numpy(float)
            unseen = np.zeros(len(sample))
            for fold in range(folds):
                own = part == fold
                w, d, b = fit_logistic(rows.take(~own), earlier[~own], wanted[~own], penalty)
                unseen[own] = sigmoid(rows.take(own).dot(w) + earlier[own] @ d + b)
            w, d, b = fit_logistic(rows, earlier, wanted, penalty)
            out += [(k, "word", vocabulary[i], w[i]) for i in np.flatnonzero(w)]
            out += [(k, "earlier", str(i), x) for i, x in enumerate(d)]
            out += [(k, "intercept", "", b), (k, "threshold", "", _best_threshold(unseen, wanted))]
            earlier = np.column_stack((earlier, unseen))
        return pd.DataFrame(out, columns=["category", "kind", "name", "value"])

    return fit


def fit_chain(documents: DataFrame, labels: DataFrame, categories: list[str], sample_rows: int = SAMPLE_ROWS,
              folds: int = FOLDS, penalty: float = PENALTY) -> Chain:
    """Fit the chain on at most ``sample_rows`` labelled rows, whole texts, in one task.

    A later category is fitted on out-of-fold probabilities of the earlier ones, so it learns how far they
    are to be trusted on unseen texts; the thresholds come from the same. Features are the different words of
    a text and their beginnings, those in three texts or more; the penalty leaves most without weight. Of rows with the same
    ``doc_id`` the one whose text has the least hash counts, of several labels of one the least. Labels that are NULL, or of no
    document, are left out. Without labelled rows nothing is toxic. Other columns are not read.
    """
    chosen = (
        labels.select("doc_id", *categories).dropna()
        .groupBy("doc_id").agg(F.min(F.struct(*categories)).alias("label")).select("doc_id", "label.*")
        .orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(sample_rows)
    )
    # The least text is told before the shuffle, so the rows of a repeated doc_id do not meet in one task.
    least = F.min(F.struct(F.xxhash64("text").alias("draw"), "text")).alias("least")
    sample = (
        documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", *categories).agg(least)
        .select("doc_id", "least.text", *categories, F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(folds)).alias("fold"))
    )
    fitted = sample.groupBy().applyInPandas(
        _fit(categories, folds, penalty), "category int, kind string, name string, value double"
    ).collect()  # words with a weight: at most the words of the sample
    n = len(categories)
    weights: dict[str, list[float]] = {}
    earlier, intercepts, thresholds = [[0.0] * k for k in range(n)], [-30.0] * n, [0.5] * n
    for r in fitted:
        k, value = r["category"], r["value"]
        if r["kind"] == "word":
            weights.setdefault(r["name"], [0.0] * n)[k] = value
        elif r["kind"] == "earlier":
            earlier[k][int(r["name"])] = value
        elif r["kind"] == "intercept":
            intercepts[k] = value
        else:
            thresholds[k] = value
    return Chain(list(categories), {w: tuple(x) for w, x in weights.items()}, earlier, intercepts, thresholds)


def score_toxicity(documents: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id``, the probability ``p_<category>`` and the verdict ``<category>`` of every row.

    Whole texts are read, once. A NULL or empty text has the intercepts' probabilities; repeated rows are
    each scored. An empty table gives no rows, and other columns are not read.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([chain.probabilities(features_of(t.as_py())) for t in batch.column(1)])
            found = found.reshape(-1, len(chain.categories))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(p) for p in found.T],
                 *[pa.array(p >= t) for p, t in zip(found.T, chain.thresholds, strict=True)]],
                names=["doc_id", *[f"p_{c}" for c in chain.categories], *chain.categories],
            )

    columns = [f"p_{c} double" for c in chain.categories] + [f"{c} boolean" for c in chain.categories]
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(columns)}")
