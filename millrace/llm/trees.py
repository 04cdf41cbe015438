"""Small boosted trees and isotonic calibration, fitted on a bounded sample.

What is fitted here are tables of a few kilobytes; the rows they are fitted on are a
sample of documented size, and scoring happens where the rows are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Complete binary trees: node k has children 2k+1 (at most the threshold) and 2k+2."""

    base: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    value: np.ndarray  # (trees, leaves)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1] if len(self.feature) else 0
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while True:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
                if not len(node) or node[0] >= inner:
                    break
            out += v[node - inner] if len(node) else 0
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))

    def paths(self) -> list[list[tuple[int, bool, float]]]:
        """Every way from a root to a node, as (feature, above, threshold) each."""
        found = {}
        for f, t in zip(self.feature, self.threshold):
            inner = len(f)
            ways: dict[int, tuple] = {0: ()}
            for k in range(inner):
                if k not in ways or not np.isfinite(t[k]):
                    continue
                for child, above in ((2 * k + 1, False), (2 * k + 2, True)):
                    ways[child] = (*ways[k], (int(f[k]), above, float(t[k])))
            found |= {w: None for w in ways.values() if w}
        return [list(w) for w in found]


def fit_boosted(
    x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 32,
    least: int = 10, ridge: float = 1.0,
) -> Boosted:
    """Gradient boosting for the logistic loss on quantile histograms."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4))
    base = float(np.log(mean / (1 - mean)))
    model = Boosted(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    if len(y) == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)])  # bin b: c <= edges[b]
    width = binned.shape[1]
    column = binned + np.arange(width) * bins
    raw = np.full(len(y), base)
    feature, threshold, value = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        f_all, t_all = np.zeros(inner, int), np.full(inner, np.inf)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (width * bins) + column).ravel()
            n = count * width * bins
            shape = (count, width, bins)
            gs = np.bincount(at, np.repeat(g, width), minlength=n).reshape(shape).cumsum(axis=2)
            hs = np.bincount(at, np.repeat(h, width), minlength=n).reshape(shape).cumsum(axis=2)
            ns = np.bincount(at, minlength=n).reshape(shape).cumsum(axis=2)
            gt, ht, nt = gs[:, :, -1:], hs[:, :, -1:], ns[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(ns < least) | (nt - ns < least)] = -1
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9:
                    f_all[first + k], t_all[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), f_all[node]] > t_all[node])
        leaf = node - inner
        v = rate * np.bincount(leaf, g, minlength=leaves) / (np.bincount(leaf, h, minlength=leaves) + ridge)
        raw += v[leaf]
        feature.append(f_all)
        threshold.append(t_all)
        value.append(v)
    return Boosted(base, np.array(feature), np.array(threshold), np.array(value))


def fit_isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing map from raw scores to shares of ones (pool adjacent
    violators), to be interpolated between them."""
    if not len(raw):
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of raw, sum of y, rows
    for r, t in zip(raw[order], y[order]):
        blocks.append([r, t, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def fit_lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1-penalised logistic regression (accelerated
    proximal gradient); the intercept is free."""
    n, k = x.shape
    lipschitz = 0.25 * (np.linalg.norm(x, 2) ** 2 / n + 1) + 1e-9
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-4) / (1 - y.mean() + 1e-4)))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(x @ vw + vb))) - y
        nw = vw - x.T @ error / n / lipschitz
        nw = np.sign(nw) * np.maximum(np.abs(nw) - penalty / lipschitz, 0)
        nb = vb - error.mean() / lipschitz
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b, w
