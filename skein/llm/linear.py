"""Small linear models in numpy: hinge loss by dual coordinate descent, and calibration of scores."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class Rows:
    """Sparse rows: ``index`` and ``value`` of row i stand at ``start[i]:start[i + 1]``."""

    def __init__(self, index: np.ndarray, value: np.ndarray, start: np.ndarray):
        self.index, self.value, self.start = index, value, start

    def __len__(self) -> int:
        return len(self.start) - 1

    def take(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.start)[rows]
        at = np.concatenate([np.arange(self.start[i], self.start[i + 1]) for i in rows]) if len(rows) else np.zeros(0, np.int64)
        return Rows(self.index[at], self.value[at], np.concatenate(([0], np.cumsum(sizes))))

    def dot(self, w: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(w[self.index] * self.value)))
        return total[self.start[1:]] - total[self.start[:-1]]


def joined_rows(parts: Iterable[Rows]) -> Rows:
    """The rows of all parts, in their order."""
    index, value, sizes = [], [], [np.zeros(1, np.int64)]
    for p in parts:
        index.append(p.index)
        value.append(p.value)
        sizes.append(np.diff(p.start))
    return Rows(np.concatenate(index), np.concatenate(value), np.cumsum(np.concatenate(sizes)))


def hinge(x: Rows, y: np.ndarray, size: int, c: float = 1.0, rounds: int = 12, balance: bool = True, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (hinge loss), by dual coordinate descent.
    y: -1 or 1. ``balance``: both classes weigh the same in total."""
    n, rng = len(x), np.random.default_rng(seed)
    cost = np.full(n, c)
    if balance and (k := (y > 0).sum()) not in (0, n):
        cost = np.where(y > 0, c * n / (2 * k), c * n / (2 * (n - k)))
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(n)
    squares = np.concatenate(([0.0], np.cumsum(x.value**2)))
    norm = squares[x.start[1:]] - squares[x.start[:-1]] + 1.0  # 1: the bias is a feature
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(n):
            s = slice(x.start[i], x.start[i + 1])
            j, v = x.index[s], x.value[s]
            slope = y[i] * (w[j] @ v + bias) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[j] += step * v  # a row has each index once
                bias += step
                most = max(most, abs(new - alpha[i]) * norm[i])
                alpha[i] = new
        if most < 1e-3:
            break
    return w, bias


def calibrated(margin: np.ndarray, label: np.ndarray, at: float = 0.3, lean: float = 0.5) -> tuple[float, float]:
    """(slope, shift) so that 1 / (1 + exp(-slope * (margin - shift))) is a probability that crosses
    ``at`` where a cut separates ``label`` best (by F1). ``lean``: where in the gap around the best
    cut, from its lower margin (0) to its upper one (1)."""
    if not len(margin) or label.min() == label.max():
        return 1.0, 0.0
    order = np.argsort(-margin, kind="stable")
    m, hits = margin[order], np.cumsum(label[order])
    f1 = 2 * hits / (np.arange(1, len(m) + 1) + hits[-1])
    f1[:-1][m[:-1] == m[1:]] = -1  # no cut between equal margins
    k = int(np.argmax(f1))
    low = m[k + 1] if k + 1 < len(m) else m[k] - 1.0
    cut = low + (m[k] - low) * lean
    spread = max(margin.std(), 1e-9)
    z, n1 = (margin - cut) / spread, label.sum()
    goal = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (len(label) - n1 + 2))
    a = 1.0
    for _ in range(50):  # Newton steps for the slope alone
        p = 1 / (1 + np.exp(-np.clip(a * z, -30, 30)))
        a -= float(((p - goal) * z).sum() / ((p * (1 - p) * z * z).sum() + 1e-3))
        a = min(max(a, 0.5), 50.0)
    slope = a / spread
    return slope, cut + np.log(1 / at - 1) / slope


def probability(margin: np.ndarray, slope: float, shift: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * (margin - shift), -500, 500)))
