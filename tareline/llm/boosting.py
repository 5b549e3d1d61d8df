"""Small numpy learners for bounded samples: bins, boosted trees, isotonic steps."""

from __future__ import annotations

import numpy as np


def quantile_edges(x: np.ndarray, n_bins: int) -> list[np.ndarray]:
    """Inner bin edges of each column; a column with few values gets few bins."""
    at = np.linspace(0, 1, n_bins + 1)[1:-1]
    return [np.unique(np.quantile(c, at)) if len(c) else np.empty(0) for c in x.T]


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def log_odds(rate: float) -> float:
    rate = min(max(rate, 1e-3), 1 - 1e-3)
    return float(np.log(rate / (1 - rate)))


class BoostedTrees:
    """Gradient-boosted trees for a 0/1 label; the nodes of a level share one split.

    A tree is a row of (feature, bin) tests and a table of 2**depth leaves, so
    scoring is one table lookup per tree for a whole batch.
    """

    def __init__(self, n_bins: int = 32, rounds: int = 60, depth: int = 4, rate: float = 0.15, l2: float = 2.0):
        self.n_bins, self.rounds, self.depth, self.rate, self.l2 = n_bins, rounds, depth, rate, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = quantile_edges(x, self.n_bins)
        self.base = log_odds(y.mean() if len(y) else 0.0)
        self.trees: list[tuple[list[tuple[int, int]], np.ndarray]] = []
        if len(y) == 0 or y.min() == y.max():
            return self
        bins, margin = to_bins(x, self.edges), np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = sigmoid(margin)
            leaf, tree = self.grow(bins, y - p, p * (1 - p))
            margin += tree[1][leaf]
            self.trees.append(tree)
        return self

    def grow(self, bins: np.ndarray, grad: np.ndarray, hess: np.ndarray):
        leaf, tests = np.zeros(len(grad), int), []
        for level in range(self.depth):
            best = (0.0, 0, 0)
            for f in range(bins.shape[1]):
                g, h = (
                    np.bincount(leaf * self.n_bins + bins[:, f], w, (1 << level) * self.n_bins)
                    .reshape(-1, self.n_bins).cumsum(axis=1)
                    for w in (grad, hess)
                )
                gain = g**2 / (h + self.l2) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + self.l2)
                gain = gain.sum(axis=0)[:-1]
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], f, at)
            tests.append(best[1:])
            leaf = leaf * 2 + (bins[:, best[1]] > best[2])
        size = 1 << self.depth
        g, h = np.bincount(leaf, grad, size), np.bincount(leaf, hess, size)
        return leaf, (tests, self.rate * g / (h + self.l2))

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins, out = to_bins(x, self.edges), np.full(len(x), self.base)
        for tests, table in self.trees:
            leaf = np.zeros(len(x), int)
            for f, at in tests:
                leaf = leaf * 2 + (bins[:, f] > at)
            out += table[leaf]
        return out


class Isotonic:
    """Non-decreasing step fit of a label on a score (pool adjacent violators), read off with interpolation."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        values, index = np.unique(score, return_inverse=True)
        weight = np.bincount(index, minlength=len(values)).astype(float)
        total = np.bincount(index, y, len(values))
        blocks: list[list[float]] = []  # sum of labels, weight, first and last score
        for s, w, v in zip(total, weight, values):
            blocks.append([s, w, v, v])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                s2, w2, _, last = blocks.pop()
                blocks[-1][0] += s2
                blocks[-1][1] += w2
                blocks[-1][3] = last
        self.at = np.array([x for b in blocks for x in b[2:]]) if blocks else np.zeros(1)
        self.level = np.repeat([b[0] / b[1] for b in blocks], 2) if blocks else np.zeros(1)
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.at, self.level)


class AdditiveModel:
    """Generalised additive model with pairwise interactions.

    Cyclic boosting: in each round every feature in turn gets one shallow tree
    (three cuts) on its own bins, then every chosen pair gets a tree of one cut
    in the first and one in the second feature on each side.  Each tree is
    added to the lookup table of its feature or pair, so scoring is a sum of
    table entries by bin.
    """

    def __init__(self, n_bins: int = 32, rounds: int = 120, pairs: int = 6, rate: float = 0.1, l2: float = 4.0):
        self.n_bins, self.rounds, self.n_pairs, self.rate, self.l2 = n_bins, rounds, pairs, rate, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        k = x.shape[1]
        self.edges = quantile_edges(x, self.n_bins)
        self.base = log_odds(y.mean() if len(y) else 0.0)
        self.tables = np.zeros((k, self.n_bins))
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables = np.zeros((0, self.n_bins, self.n_bins))
        if len(y) == 0 or y.min() == y.max():
            return self
        bins, margin = to_bins(x, self.edges), np.full(len(y), self.base)
        for _ in range(self.rounds):
            for f in range(k):
                p = sigmoid(margin)
                step = self.one_feature_tree(*self.sums(bins[:, f], y - p, p * (1 - p), self.n_bins))
                self.tables[f] += step
                margin += step[bins[:, f]]
        p = sigmoid(margin)
        cells = {(a, b): bins[:, a] * self.n_bins + bins[:, b] for a in range(k) for b in range(a + 1, k)}
        gains = {ab: self.pair_tree(*self.sums(c, y - p, p * (1 - p), self.n_bins**2))[0] for ab, c in cells.items()}
        self.pairs = sorted(gains, key=lambda ab: (-gains[ab], ab))[: self.n_pairs]
        self.pair_tables = np.zeros((len(self.pairs), self.n_bins, self.n_bins))
        for _ in range(self.rounds // 2):
            for i, ab in enumerate(self.pairs):
                p = sigmoid(margin)
                _, step = self.pair_tree(*self.sums(cells[ab], y - p, p * (1 - p), self.n_bins**2))
                self.pair_tables[i] += step
                margin += step.ravel()[cells[ab]]
        return self

    @staticmethod
    def sums(cell: np.ndarray, grad: np.ndarray, hess: np.ndarray, size: int):
        return np.bincount(cell, grad, size), np.bincount(cell, hess, size)

    def best_cut(self, g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
        """Gain of the best cut of ordered bins, and the first bin to its right."""
        if len(g) < 2:
            return 0.0, len(g)
        gl, hl = g.cumsum()[:-1], h.cumsum()[:-1]
        gain = gl**2 / (hl + self.l2) + (g.sum() - gl) ** 2 / (h.sum() - hl + self.l2) - g.sum() ** 2 / (h.sum() + self.l2)
        at = int(gain.argmax())
        return float(gain[at]), at + 1

    def leaf(self, g: np.ndarray, h: np.ndarray) -> float:
        return self.rate * g.sum() / (h.sum() + self.l2)

    def one_feature_tree(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        _, middle = self.best_cut(g, h)
        cuts = [0, middle, len(g)]
        for a, b in ((0, middle), (middle, len(g))):
            gain, at = self.best_cut(g[a:b], h[a:b])
            if gain > 0:
                cuts.append(a + at)
        step, cuts = np.zeros(len(g)), sorted(set(cuts))
        for a, b in zip(cuts, cuts[1:]):
            step[a:b] = self.leaf(g[a:b], h[a:b])
        return step

    def pair_tree(self, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        g, h = g.reshape(self.n_bins, -1), h.reshape(self.n_bins, -1)
        best, step = 0.0, np.zeros_like(g)
        for flip in (False, True):
            a, b = (g.T, h.T) if flip else (g, h)
            gain, at = self.best_cut(a.sum(axis=1), b.sum(axis=1))
            made, total = np.zeros_like(a), gain
            for rows in (slice(0, at), slice(at, None)):
                gain, cut = self.best_cut(a[rows].sum(axis=0), b[rows].sum(axis=0))
                made[rows, :cut], made[rows, cut:] = self.leaf(a[rows, :cut], b[rows, :cut]), self.leaf(a[rows, cut:], b[rows, cut:])
                total += gain
            if total > best:
                best, step = total, made.T if flip else made
        return best, step

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins, out = to_bins(x, self.edges), np.full(len(x), self.base)
        for f, entries in enumerate(self.tables):
            out += entries[bins[:, f]]
        for (a, b), entries in zip(self.pairs, self.pair_tables):
            out += entries[bins[:, a], bins[:, b]]
        return out
