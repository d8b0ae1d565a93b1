"""Sparse logistic regression for classifiers fitted on a bounded sample of labelled rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Sparse:
    """Rows of nonzero features: values[k] of feature index[k] in row row[k]."""

    index: np.ndarray
    row: np.ndarray
    values: np.ndarray
    rows: int

    @classmethod
    def of(cls, features: list[np.ndarray]) -> Sparse:
        """Binary features, one array of indexes a row."""
        lengths = np.fromiter(map(len, features), np.int64, len(features))
        index = np.concatenate(features) if len(features) else np.empty(0, np.int64)
        return cls(index.astype(np.int64), np.repeat(np.arange(len(features)), lengths), np.ones(len(index)), len(features))

    def kept(self, at: np.ndarray) -> Sparse:
        """Only the features with at[f] >= 0, renumbered to at[f]."""
        new = at[self.index]
        keep = new >= 0
        return Sparse(new[keep], self.row[keep], self.values[keep], self.rows)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.values * weights[self.index], minlength=self.rows)

    def back(self, residual: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.index, weights=self.values * residual[self.row], minlength=width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def telling(x: Sparse, y: np.ndarray, width: int, z: float, least: int = 3, both: bool = False) -> np.ndarray:
    """Renumbering of the features whose log-odds of label 1 exceed zero by z standard errors (with both: differ from it), -1 for the rest."""
    ones = np.bincount(x.index, weights=y[x.row], minlength=width)
    zeros = np.bincount(x.index, minlength=width) - ones
    n1, n0 = y.sum(), len(y) - y.sum()
    parts = [np.maximum(v, 0) + 0.1 for v in (ones, n1 - ones, zeros, n0 - zeros)]
    score = (np.log(parts[0] / parts[1]) - np.log(parts[2] / parts[3])) / np.sqrt(sum(1 / v for v in parts))
    keep = ((np.abs(score) if both else score) > z) & (ones + zeros >= least)
    return np.where(keep, np.cumsum(keep) - 1, -1)


def fit(x: Sparse, y: np.ndarray, width: int, ridge: float = 1e-4, weight: np.ndarray | None = None, pairs: Sparse | None = None, pull: float = 0.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge-regularised logistic regression (Adam, full batches).

    pairs: rows of feature differences between a text and its counterfactual; `pull` times the mean squared score
    change over them is added to the loss, so the fitted score barely moves when such a swap is made.
    """
    weight = np.ones(len(y)) if weight is None else weight
    total = max(weight.sum(), 1e-9)
    rate = np.clip((weight * y).sum() / total, 1e-3, 1 - 1e-3)
    w, b = np.zeros(width), float(np.log(rate / (1 - rate)))
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, rounds + 1):
        residual = (sigmoid(x.times(w) + b) - y) * weight / total
        grad = np.append(x.back(residual, width) + ridge * w, residual.sum())
        if pairs is not None and pairs.rows and pull:
            grad[:-1] += pairs.back(2 * pull * pairs.times(w) / pairs.rows, width)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - float(move[-1])
    return w, b


def platt(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Calibration p = sigmoid(a * score + c) by Newton steps on smoothed targets; the identity where one label is missing."""
    ones = y.sum()
    if not 0 < ones < len(y):
        return 1.0, 0.0
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * scores + c)
        r, v = p - target, np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(v * scores * scores).sum() + 1e-6, (v * scores).sum()], [(v * scores).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([(r * scores).sum(), r.sum()]))
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        a, c = a - step[0], c - step[1]
    return max(float(a), 1e-3), float(c)
