"""Gradient-boosted trees for a yes or no, in numpy: histograms of quantile bins, trees grown by level."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees: in each, node k has the children 2k + 1 and 2k + 2; a row goes left if its feature is at most the threshold."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    depth: int

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = (1 << self.depth) - 1
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += v[at - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 5, rate: float = 0.15, bins: int = 32, l2: float = 2.0, weight: np.ndarray | None = None, columns: float = 1.0) -> Trees:
    """Trees for P(y = 1) by Newton boosting of the log loss; each tree sees a share ``columns`` of the features. Deterministic."""
    rng = np.random.default_rng(1)
    w = np.ones(len(x)) if weight is None else weight
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)], 1)
    n = len(x)
    useful = np.flatnonzero([len(c) > 0 and np.ptp(col) > 0 for c, col in zip(cuts, x.T, strict=True)])
    prior = float(np.clip(np.average(y, weights=w), 1e-3, 1 - 1e-3))
    score = np.full(n, np.log(prior / (1 - prior)))
    base, inner = float(score[0]), (1 << depth) - 1
    out = Trees(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 1 << depth)), depth)
    for k in range(trees):
        some = useful if columns >= 1 else np.sort(rng.choice(useful, max(1, int(columns * len(useful))), replace=False))
        m = len(some)
        flat = binned[:, some] + np.arange(m) * bins
        p = 1 / (1 + np.exp(-score))
        g, h = w * (y - p), w * p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            cell = ((at - first)[:, None] * (m * bins) + flat).ravel()
            size = width * m * bins
            hg = np.bincount(cell, np.repeat(g, m), size).reshape(width, m, bins).cumsum(2)
            hh = np.bincount(cell, np.repeat(h, m), size).reshape(width, m, bins).cumsum(2)
            tg, th = hg[:, :1, -1:], hh[:, :1, -1:]
            gain = hg**2 / (hh + l2) + (tg - hg) ** 2 / (th - hh + l2) - tg**2 / (th + l2)
            gain[(hh < 1) | (th - hh < 1)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for node in range(width):
                j, b = divmod(int(best[node]), bins)
                f = some[j]
                if gain[node, j, b] > 1e-6 and b < len(cuts[f]):
                    out.feature[k, first + node], out.threshold[k, first + node] = f, cuts[f][b]
            at = 2 * at + 1 + (x[np.arange(n), out.feature[k, at]] > out.threshold[k, at])
        own = at - inner
        sg, sh = np.bincount(own, g, 1 << depth), np.bincount(own, h, 1 << depth)
        out.leaf[k] = rate * sg / (sh + l2)
        score += out.leaf[k, own]
    return out
