"""Gradient-boosted trees in numpy, with monotonic constraints, flattened into node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees' nodes in one set of arrays; a leaf has feature -1 and points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row: every row walks every tree one level at a time."""
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                low = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(low, self.left[at], self.right[at])
            out += self.value[at]
        return out


def fit(
    x: np.ndarray, y: np.ndarray, monotone: list[int], *, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 20, l2: float = 1.0
) -> Forest:
    """Logistic loss. monotone: per feature 1 (the score may only rise with it), -1 or 0.

    A split on a constrained feature must order its children's values, and what lies below each
    child is clamped at the middle between them, so that the whole tree is monotonic.
    """
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    score = np.full(n, bias)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, len(left)), (right, len(right)), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, level: int) -> int:
        at = node()
        sum_g, sum_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        for j in range(width) if level < depth and len(rows) >= 2 * least else ():
            b, size = binned[rows, j], len(cuts[j]) + 1
            gl, hl, nl = (np.bincount(b, w, size).cumsum()[:-1] for w in (g[rows], h[rows], None))
            gr, hr, nr = sum_g - gl, sum_h - hl, len(rows) - nl
            vl, vr = np.clip(gl / (hl + l2), low, high), np.clip(gr / (hr + l2), low, high)
            won = gl * vl - (hl + l2) * vl**2 / 2 + gr * vr - (hr + l2) * vr**2 / 2
            ok = (nl >= least) & (nr >= least) & ((vr - vl) * monotone[j] >= 0)
            if ok.any():
                k = int(np.where(ok, won, -np.inf).argmax())
                if won[k] - sum_g**2 / (sum_h + l2) / 2 > best[0]:
                    best = (won[k] - sum_g**2 / (sum_h + l2) / 2, (j, k, vl[k], vr[k]))
        if best[1] is None:
            value[at] = rate * float(np.clip(sum_g / (sum_h + l2), low, high))
            score[rows] += value[at]
            return at
        j, k, vl, vr = best[1]
        feature[at], threshold[at] = j, float(cuts[j][k])
        goes = binned[rows, j] <= k
        middle = (vl + vr) / 2
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[monotone[j]]
        left[at] = grow(rows[goes], g, h, *bounds[0], level + 1)
        right[at] = grow(rows[~goes], g, h, *bounds[1], level + 1)
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(n), y - p, p * (1 - p), -np.inf, np.inf, 0))
    arrays = (np.array(a) for a in (roots, feature, threshold, left, right, value))
    return Forest(*arrays, bias, depth)
