"""Small numpy fits for one series at a time; Spark partitions the series around them."""

from __future__ import annotations

import numpy as np

#: Share of a fit's value below which a gain cannot be told from rounding.
VISIBLE = 1e-13


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, start: np.ndarray | None = None) -> np.ndarray:
    """L2 logistic regression by damped Newton steps; returns the intercept and then the weights.

    Minimises ``|w|^2 / 2 + c * loss`` with a free intercept. Where columns are small or nearly dependent, rounding hides the last gains
    before the gradient is small enough: a fit whose next step promises less than ``VISIBLE`` of the value, and does not bring it, has arrived.
    """
    design = np.column_stack([np.ones(len(x)), x])
    weight = np.zeros(design.shape[1]) if start is None else start.copy()
    if y.min() == y.max():
        weight[:] = 0.0
        weight[0] = 30.0 if y.max() == 1 else -30.0
        return weight
    ridge = np.full(design.shape[1], 1.0 / c)
    ridge[0] = 0.0

    def objective(w: np.ndarray) -> float:
        z = design @ w
        return float(np.sum(np.logaddexp(0.0, z) - y * z) + 0.5 * np.sum(ridge * w * w))

    value = objective(weight)
    for _ in range(100):
        p = sigmoid(design @ weight)
        gradient = design.T @ (p - y) + ridge * weight
        hessian = (design * (p * (1.0 - p))[:, None]).T @ design + np.diag(ridge + 1e-12)
        step = np.linalg.solve(hessian, gradient)
        scale = 1.0
        while scale > 1e-8 and objective(weight - scale * step) > value:
            scale /= 2.0
        if scale < 1.0 and abs(gradient @ step) <= VISIBLE * (1.0 + abs(value)):
            return weight - step
        weight = weight - scale * step
        value = objective(weight)
        if np.max(np.abs(gradient)) < 1e-9 or np.max(np.abs(step)) < 1e-10:
            break
    return weight


class Logistic:
    """Optionally standardised (population deviation) logistic model."""

    def __init__(self, scale: bool = True, c: float = 1.0):
        self.scale, self.c = scale, c
        self.weight: np.ndarray | None = None

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.spread

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Logistic":
        self.mean = x.mean(axis=0) if self.scale else np.zeros(x.shape[1])
        spread = x.std(axis=0) if self.scale else np.ones(x.shape[1])
        self.spread = np.where(spread == 0.0, 1.0, spread)
        # The previous fit is a good start for a slightly longer history.
        self.weight = fit_logistic(self._scaled(x), y, self.c, self.weight)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.weight[0] + self._scaled(x) @ self.weight[1:])


class BoostedTrees:
    """Gradient-boosted trees of fixed depth on binned features with a log-loss objective."""

    def __init__(self, rounds: int = 300, rate: float = 0.05, depth: int = 3, min_leaf: int = 20, bins: int = 255):
        self.rounds, self.rate, self.depth, self.min_leaf, self.bins = rounds, rate, depth, min_leaf, bins

    def _edges(self, column: np.ndarray) -> np.ndarray:
        seen = np.unique(column)
        if len(seen) <= self.bins:
            return (seen[:-1] + seen[1:]) / 2.0
        return np.unique(np.quantile(column, np.linspace(0.0, 1.0, self.bins + 1)[1:-1]))

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)])

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        self.edges = [self._edges(x[:, j]) for j in range(x.shape[1])]
        codes = self._codes(x)
        n, k = codes.shape
        width = max(len(e) for e in self.edges) + 1
        cell = codes + np.arange(k) * width
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(share / (1.0 - share)))
        raw = np.full(n, self.base)
        self.trees = []
        rows = np.arange(n)
        for _ in range(self.rounds):
            p = sigmoid(raw)
            grad, hess = p - y, p * (1.0 - p)
            grad_k, hess_k = np.repeat(grad, k), np.repeat(hess, k)
            node = np.zeros(n, dtype=np.int64)
            splits = []
            for level in range(self.depth):
                feature, cut = self._best(node, cell, grad_k, hess_k, 2**level, k, width)
                splits.append((feature, cut))
                node = 2 * node + (codes[rows, feature[node]] > cut[node])
            leaves = 2**self.depth
            g = np.bincount(node, grad, leaves)
            h = np.bincount(node, hess, leaves)
            leaf = np.where(h > 0, -self.rate * g / np.where(h > 0, h, 1.0), 0.0)
            raw += leaf[node]
            self.trees.append((splits, leaf))
        return self

    def _best(self, node, cell, grad_k, hess_k, nodes, k, width):
        """Best (feature, last bin going left) of every node; a node without a split keeps all rows left."""
        at = (node[:, None] * (k * width) + cell).ravel()
        size = nodes * k * width
        shape = (nodes, k, width)
        g = np.bincount(at, grad_k, size).reshape(shape).cumsum(axis=2)
        h = np.bincount(at, hess_k, size).reshape(shape).cumsum(axis=2)
        m = np.bincount(at, minlength=size).reshape(shape).cumsum(axis=2)
        g_all, h_all, m_all = g[:, :, -1:], h[:, :, -1:], m[:, :, -1:]
        h_right = h_all - h
        allowed = (m >= self.min_leaf) & (m_all - m >= self.min_leaf) & (h >= 1e-3) & (h_right >= 1e-3)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = g**2 / h + (g_all - g) ** 2 / h_right - g_all**2 / h_all
        gain = np.where(allowed, gain, -np.inf).reshape(nodes, k * width)
        best = gain.argmax(axis=1)
        found = gain[np.arange(nodes), best] > 0
        return np.where(found, best // width, 0), np.where(found, best % width, width)

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes = self._codes(x)
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for splits, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for feature, cut in splits:
                node = 2 * node + (codes[rows, feature[node]] > cut[node])
            raw += leaf[node]
        return sigmoid(raw)


def fit_isotonic(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing least-squares steps through (p, y): the points to interpolate between."""
    points, inverse = np.unique(p, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    level = np.bincount(inverse, y) / weight
    blocks: list[list[float]] = []
    for v, w in zip(level, weight):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, c2 = blocks.pop()
            v1, w1, c1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, c1 + c2])
    fitted = np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])
    return points, fitted


def apply_isotonic(points: np.ndarray, fitted: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Linear between the points, constant outside them."""
    return np.interp(p, points, fitted)
