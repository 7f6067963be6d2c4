"""Sparse logistic regression on a bounded sample, inside one task."""

from __future__ import annotations

import numpy as np


class Rows:
    """Sets of features by row: row i has ``items[starts[i]:starts[i + 1]]``, each with value one."""

    def __init__(self, rows: list[list[int]], width: int) -> None:
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.items = np.fromiter((i for r in rows for i in r), np.int64, int(self.lengths.sum()))
        self.of = np.repeat(np.arange(len(rows)), self.lengths)
        self.width = width

    def take(self, chosen: np.ndarray) -> Rows:
        part = Rows([], self.width)
        place = np.cumsum(chosen) - 1
        own = chosen[self.of]
        part.lengths, part.items, part.of = self.lengths[chosen], self.items[own], place[self.of[own]]
        return part

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights[self.items], minlength=len(self.lengths))

    def sums(self, by_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.items, by_row[self.of], minlength=self.width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_logistic(
    rows: Rows, dense: np.ndarray, wanted: np.ndarray, penalty: float, rounds: int = 150
) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the sets' features and of the ``dense`` columns, and the intercept.

    Proximal gradient steps with momentum; ``penalty`` on the absolute weights of the sets' features, so that
    most are zero; the others are free. Each step is scaled by the number of rows a feature is in.
    """
    n = max(1, len(wanted))
    seen = rows.sums(np.ones(len(wanted)))
    # A bound of the curvature along each feature: its rows, times the most features a row has.
    most = 1 + dense.shape[1] + np.sqrt(float(rows.lengths.max(initial=1)))
    step = 4 * n / (most * np.maximum(seen, 0.01 * n))
    free_step = 4 / most
    w, d, b = np.zeros(rows.width), np.zeros(dense.shape[1]), 0.0
    ahead, momentum = (w, d, b), 1.0
    for _ in range(rounds):
        vw, vd, vb = ahead
        error = (sigmoid(rows.dot(vw) + dense @ vd + vb) - wanted) / n
        new_w = vw - step * rows.sums(error)
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * penalty, 0)
        new_d, new_b = vd - free_step * (dense.T @ error), vb - free_step * error.sum()
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        pull = (momentum - 1) / following
        if (vw - new_w) @ (new_w - w) + (vd - new_d) @ (new_d - d) + (vb - new_b) * (new_b - b) > 0:
            following, pull = 1.0, 0.0  # momentum points uphill: start it anew
        ahead = (new_w + pull * (new_w - w), new_d + pull * (new_d - d), new_b + pull * (new_b - b))
        w, d, b, momentum = new_w, new_d, new_b, following
    return w, d, float(b)
