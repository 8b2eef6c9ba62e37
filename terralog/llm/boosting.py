"""Gradient-boosted trees in numpy: histogram splits, log loss, monotonic features, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .base import sigmoid


@dataclass
class Forest:
    """All trees' nodes in flat arrays; ``left`` of a leaf is the leaf itself. ``roots``: first node of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row: all rows step down all trees at once, ``depth`` times."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0, least: int = 10, prior: float | None = None) -> Forest:
    """``monotone``: per feature -1 (score may not rise with it), 1 (may not fall) or 0.

    A split of a monotonic feature must order its leaf values, and their mean bounds all values below either side, so
    each tree, and their sum, keeps the order. Without rows of both labels there are no trees, only the base rate.
    """
    rate1 = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    base = float(np.log(rate1 / (1 - rate1)))
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T] if len(x) else []
    codes = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)]) if len(x) else np.zeros((0, len(monotone)), int)
    f = np.full(len(y), base)
    for _ in range(trees if len(np.unique(y)) == 2 else 0):
        p = sigmoid(f)
        g, h = y - p, p * (1 - p)
        roots.append(len(nodes))
        step = np.zeros(len(y))

        def grow(rows: np.ndarray, level: int, lo: float, hi: float) -> int:
            me = len(nodes)
            total = g[rows].sum(), h[rows].sum()
            value = float(np.clip(total[0] / (total[1] + ridge), lo, hi))
            nodes.append([0, np.inf, me, me, rate * value])
            best = None
            for j in range(x.shape[1]) if level < depth and len(rows) >= 2 * least else ():
                n = len(cuts[j]) + 1
                if n < 2:
                    continue
                c = codes[rows, j]
                gs, hs, ns = (np.cumsum(np.bincount(c, w, n))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                vl, vr = gs / (hs + ridge), (total[0] - gs) / (total[1] - hs + ridge)
                gain = gs * vl + (total[0] - gs) * vr - total[0] ** 2 / (total[1] + ridge)
                ok = (ns >= least) & (len(rows) - ns >= least) & (monotone[j] * (np.clip(vr, lo, hi) - np.clip(vl, lo, hi)) >= 0)
                gain = np.where(ok, gain, -1)
                k = int(gain.argmax())
                if gain[k] > 1e-3 and (best is None or gain[k] > best[0]):
                    best = (gain[k], j, k, float(np.clip(vl[k], lo, hi)), float(np.clip(vr[k], lo, hi)))
            if best is None:
                step[rows] = rate * value
                return me
            _, j, k, vl, vr = best
            mid = (vl + vr) / 2
            low, high = ((lo, mid), (mid, hi)) if monotone[j] > 0 else ((mid, hi), (lo, mid)) if monotone[j] < 0 else ((lo, hi), (lo, hi))
            side = codes[rows, j] <= k
            nodes[me][:2] = [j, float(cuts[j][k])]
            nodes[me][2] = grow(rows[side], level + 1, *low)
            nodes[me][3] = grow(rows[~side], level + 1, *high)
            return me

        grow(np.arange(len(y)), 0, -np.inf, np.inf)
        f += step
    if prior is not None:
        prior = float(np.clip(prior, 1e-4, 1 - 1e-4))
        base += np.log(prior / (1 - prior)) - np.log(rate1 / (1 - rate1))
    a = np.array(nodes or [[0, np.inf, 0, 0, 0.0]], dtype=float)
    return Forest(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots, dtype=int), depth, float(base))
