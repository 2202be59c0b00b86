"""Small gradient-boosted trees in numpy: histogram splits, monotone constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees as flat arrays, one row per tree; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row of x."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t, at]
                at = np.where(x[rows, f] <= self.threshold[t, at], self.left[t, at], self.right[t, at])
            total += self.value[t, at]
        return total


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 1.0, min_rows: int = 5) -> Forest:
    """Logistic boosting. monotone holds +1, 0 or -1 per feature; a constrained feature's splits keep their children in
    order, and the children's subtrees stay on either side of the middle between them."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else x[:, j] for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], axis=1)
    nodes = 2 ** (depth + 1) - 1
    feature = np.zeros((trees, nodes), np.int64)
    threshold = np.zeros((trees, nodes))
    left = np.tile(np.arange(nodes), (trees, 1))
    right = left.copy()
    value = np.zeros((trees, nodes))
    rate_of = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(rate_of / (1 - rate_of)))
    score = np.full(n, base)

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(g / (h + l2), low, high))

    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        todo = [(0, np.arange(n), -np.inf, np.inf, 0)]
        while todo:
            at, rows, low, high, level = todo.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            value[t, at] = rate * leaf(g, h, low, high)
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * min_rows:
                for j in range(d):
                    m = len(edges[j])
                    if not m:
                        continue
                    b = binned[rows, j]
                    gl = np.bincount(b, grad[rows], m + 1).cumsum()[:-1]
                    hl = np.bincount(b, hess[rows], m + 1).cumsum()[:-1]
                    nl = np.bincount(b, minlength=m + 1).cumsum()[:-1]
                    vl, vr = np.clip(gl / (hl + l2), low, high), np.clip((g - gl) / (h - hl + l2), low, high)
                    gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
                    ok = (nl >= min_rows) & (len(rows) - nl >= min_rows)
                    if monotone[j]:
                        ok &= monotone[j] * (vr - vl) >= 0
                    gain = np.where(ok, gain, -1.0)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (j, k, vl[k], vr[k]))
            if best[1] is None:
                score[rows] += value[t, at]
                continue
            j, k, vl, vr = best[1]
            feature[t, at], threshold[t, at] = j, edges[j][k]
            left[t, at], right[t, at] = 2 * at + 1, 2 * at + 2
            mid = (vl + vr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[int(monotone[j])]
            goes_left = binned[rows, j] <= k
            for child, part, (a, b) in ((2 * at + 1, rows[goes_left], bounds[0]), (2 * at + 2, rows[~goes_left], bounds[1])):
                todo.append((child, part, a, b, level + 1))
    return Forest(feature, threshold, left, right, value, base, depth)
