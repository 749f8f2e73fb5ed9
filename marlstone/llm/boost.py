"""Gradient-boosted trees for a yes-or-no label, and isotonic calibration, in NumPy.

Trees are complete to a fixed depth and split on histograms of quantile bins, with Newton leaf
values of the logistic loss. The result doesn't depend on chance: equal rows in equal order give
equal models.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    base: float
    depth: int
    features: list[np.ndarray] = field(default_factory=list)  # of each inner node, tree by tree
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - len(f)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, l2: float = 2.0) -> Boosted:
    n, m = x.shape
    share = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
    model = Boosted(float(np.log(share / (1 - share))), depth)
    if n == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    code = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], 1)
    margin = np.full(n, model.base)
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            nodes, low = 2**level, 2**level - 1
            best = np.full(nodes, 1e-6)
            split = np.full(nodes, -1)
            for j in range(m):
                if not len(edges[j]):
                    continue
                key = (at - low) * (bins + 1) + code[:, j]
                sg = np.bincount(key, g, nodes * (bins + 1)).reshape(nodes, -1).cumsum(1)
                sh = np.bincount(key, h, nodes * (bins + 1)).reshape(nodes, -1).cumsum(1)
                tg, th = sg[:, -1:], sh[:, -1:]
                gain = sg**2 / (sh + l2) + (tg - sg) ** 2 / (th - sh + l2) - tg**2 / (th + l2)
                gain = gain[:, : len(edges[j])]
                k = gain.argmax(1)
                top = gain[np.arange(nodes), k]
                better = top > best
                best[better], split[better] = top[better], k[better]
                feature[low : low + nodes][better] = j
            ok = split >= 0
            cut[low : low + nodes][ok] = [edges[f][k] for f, k in zip(feature[low : low + nodes][ok], split[ok], strict=True)]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        model.features.append(feature)
        model.cuts.append(cut)
        model.leaves.append(value)
        margin += value[leaf]
    return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the nondecreasing least-squares fit of y on margin (pool adjacent violators)."""
    if not len(y):
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of margins
    for m, v in zip(margin[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(m)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, c, t = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + c, blocks[-1][2] + t]
    b = np.array(blocks)
    return b[:, 2] / b[:, 1], b[:, 0] / b[:, 1]
