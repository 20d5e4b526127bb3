"""Histogram gradient-boosted trees for a 0/1 label, flattened into arrays.

Features are cut into bins once; a node's histogram sums gradients and curvatures per bin, and the
best cut is the one with the largest gain. A feature may be constrained to act upwards or downwards
only: a cut that breaks the order is not taken, and both sides are bounded by the middle of it.
Scoring walks all rows down all trees level by level with numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Node arrays of all trees, one row a tree; a leaf points to itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def raw(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.base)
        at = np.arange(len(rows))
        for feature, cut, left, right, value in zip(self.feature, self.cut, self.left, self.right, self.value, strict=True):
            node = np.zeros(len(rows), np.int32)
            for _ in range(self.depth):
                node = np.where(rows[at, feature[node]] <= cut[node], left[node], right[node])
            out += value[node]
        return out

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -40, 40)))


def fit(
    rows: np.ndarray,
    labels: np.ndarray,
    trees: int = 80,
    depth: int = 4,
    rate: float = 0.1,
    bins: int = 64,
    ridge: float = 5.0,
    least: float = 20.0,
    monotone: dict[int, int] | None = None,
) -> Forest:
    """Fit trees by the logistic loss. ``monotone``: +1 or -1 by feature index.

    Without rows, or with one label only, the forest is a constant (0.5 without rows).
    """
    monotone = monotone or {}
    count, width = rows.shape
    positive = float(labels.sum())
    base = float(np.log((positive + 1) / (count - positive + 1)))
    size = 2 ** (depth + 1) - 1
    shape = (trees if 0 < positive < count else 0, size)
    feature, cut = np.zeros(shape, np.int32), np.zeros(shape)
    left = np.tile(np.arange(size, dtype=np.int32), (shape[0], 1))
    right, value = left.copy(), np.zeros(shape)
    forest = Forest(feature, cut, left, right, value, base, depth)
    if not shape[0]:
        return forest
    edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.column_stack([np.searchsorted(edges[j], rows[:, j], side="left") for j in range(width)]).astype(np.int64)
    raw = np.full(count, base)
    for t in range(shape[0]):
        p = 1 / (1 + np.exp(-raw))
        gradient, curve = p - labels, np.maximum(p * (1 - p), 1e-9)
        members = {0: np.arange(count)}
        bounds = {0: (-np.inf, np.inf)}
        free = 1
        for _ in range(depth):
            following: dict[int, np.ndarray] = {}
            for node, own in members.items():
                found = _best_cut(binned[own], gradient[own], curve[own], edges, bounds[node], ridge, least, monotone, bins)
                if found is None:
                    continue
                j, b, low, high = found
                a, c = free, free + 1
                free += 2
                feature[t, node], cut[t, node], left[t, node], right[t, node] = j, edges[j][b], a, c
                goes = binned[own, j] <= b
                following[a], following[c] = own[goes], own[~goes]
                lo, hi = bounds[node]
                middle = (low + high) / 2
                side = monotone.get(j, 0)
                bounds[a] = (lo, middle) if side > 0 else (middle, hi) if side < 0 else (lo, hi)
                bounds[c] = (middle, hi) if side > 0 else (lo, middle) if side < 0 else (lo, hi)
                for kid, out in ((a, low), (c, high)):
                    value[t, kid] = rate * out
            if not following:
                break
            members = following
        node = np.zeros(count, np.int32)
        for _ in range(depth):
            node = np.where(rows[np.arange(count), feature[t][node]] <= cut[t][node], left[t][node], right[t][node])
        raw += value[t][node]
    return forest


def _best_cut(binned, gradient, curve, edges, bounds, ridge, least, monotone, bins):
    """Feature, bin and both outputs of the cut with the largest gain, or None."""
    best, found = 1e-6, None
    total_g, total_h = gradient.sum(), curve.sum()
    for j in range(binned.shape[1]):
        cuts = len(edges[j])
        if not cuts:
            continue
        number = np.bincount(binned[:, j], minlength=bins + 1)[:cuts].cumsum()
        g = np.bincount(binned[:, j], gradient, bins + 1)[:cuts].cumsum()
        h = np.bincount(binned[:, j], curve, bins + 1)[:cuts].cumsum()
        low = np.clip(-g / (h + ridge), *bounds)
        high = np.clip(-(total_g - g) / (total_h - h + ridge), *bounds)

        def gain(g, h, out):
            return -(g * out + 0.5 * (h + ridge) * out**2)

        whole = np.clip(-total_g / (total_h + ridge), *bounds)
        won = gain(g, h, low) + gain(total_g - g, total_h - h, high) - gain(total_g, total_h, whole)
        won[(number < least) | (len(binned) - number < least)] = -np.inf
        side = monotone.get(j, 0)
        if side:
            won[side * (high - low) < 0] = -np.inf
        b = int(np.argmax(won))
        if won[b] > best:
            best, found = won[b], (j, b, float(low[b]), float(high[b]))
    return found
