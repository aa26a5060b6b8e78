"""Gradient-boosted trees for a few thousand rows: logistic loss, depth-limited trees, quantile bins. Trained on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Trees:
    """Each tree is complete: node k has children 2k+1 and 2k+2; a node that doesn't split sends all to the left."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    at: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        x = np.atleast_2d(np.asarray(x, float))
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for f, a, leaf in zip(self.feature, self.at, self.leaf, strict=True):
            k = np.zeros(len(x), int)
            while (k < inner).any():
                k = 2 * k + 1 + (x[rows, f[np.minimum(k, inner - 1)]] > a[np.minimum(k, inner - 1)])
            out += leaf[k - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(x))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.25, l2: float = 1.0, least: int = 10) -> Trees:
    x, y = np.asarray(x, float), np.asarray(y, float)
    base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    cutpoints = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cutpoints)], 1)
    inner, leaves = 2**depth - 1, 2**depth
    z = np.full(len(x), base)
    fs, ats, ls = [], [], []
    for _ in range(trees):
        p = _sigmoid(z)
        g, h = y - p, p * (1 - p)
        feature, at, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(x), int)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best = (1e-6, 0, np.inf, 0)
            if len(rows) >= 2 * least:
                gs, hs = g[rows].sum(), h[rows].sum()
                for f, c in enumerate(cutpoints):
                    n = len(c) + 1
                    b = bins[rows, f]
                    gl, hl, cl = (np.cumsum(np.bincount(b, w, n))[:-1] for w in (g[rows], h[rows], None))
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    gain[(cl < least) | (len(rows) - cl < least)] = 0
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), f, c[gain.argmax()], int(gain.argmax()))
            feature[k], at[k] = best[1], best[2]
            right = bins[rows, best[1]] > best[3] if np.isfinite(best[2]) else np.zeros(len(rows), bool)
            node[rows] = 2 * k + 1 + right
        leaf = np.zeros(leaves)
        for k in range(leaves):
            rows = node == inner + k
            leaf[k] = rate * g[rows].sum() / (h[rows].sum() + l2)
        z += leaf[node - inner]
        fs.append(feature), ats.append(at), ls.append(leaf)
    return Trees(base, np.array(fs), np.array(ats), np.array(ls))


def threshold(scores: np.ndarray, y: np.ndarray, precision: float, default: float = 0.9) -> float:
    """The lowest score from which on held-out rows are right at least at ``precision``."""
    order = np.argsort(-scores, kind="stable")
    hit = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ok = np.flatnonzero(hit >= precision)
    return float(scores[order][ok[-1]]) if len(ok) else default
