"""Small tree models over dense features: gradient boosting with isotonic calibration, and a random forest.

They are fitted on a bounded sample on the driver and go to the executors as a few arrays. Features are binned to at most
BINS quantile steps; all trees are complete binary trees of one depth, so that scoring is array indexing only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 64


def _edges(x: np.ndarray) -> list[np.ndarray]:
    steps = np.linspace(0, 1, BINS + 1)[1:-1]
    out = []
    for column in x.T:
        values = np.unique(column)
        mids = (values[1:] + values[:-1]) / 2
        out.append(mids if len(mids) < BINS else np.unique(np.quantile(values, steps)))
    return out


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.int64)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, x[:, j], side="left")
    return out


@dataclass
class Tree:
    """Node i has children 2i+1 and 2i+2; a row goes right if its feature is above the cut."""

    depth: int
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[at]] > self.cut[at])
        return at - (2**self.depth - 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaf(x)]


def _grow(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: float, l2: float, pick=None) -> tuple[Tree, np.ndarray]:
    """Splits by gain of (sum g)^2 / (sum h + l2); leaves hold sum g / (sum h + l2). pick chooses features for a node."""
    n, width = binned.shape
    inner = 2**depth - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
    at = np.zeros(n, np.int64)
    for level in range(depth):
        first, nodes = 2**level - 1, 2**level
        local = at - first
        best = np.zeros(nodes)
        for j in range(width):
            if not len(edges[j]):
                continue
            slot = local * BINS + binned[:, j]
            gs = np.bincount(slot, g, nodes * BINS).reshape(nodes, BINS).cumsum(1)
            hs = np.bincount(slot, h, nodes * BINS).reshape(nodes, BINS).cumsum(1)
            gt, ht = gs[:, -1:], hs[:, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            gain[(hs < least) | (ht - hs < least)] = 0
            gain[:, len(edges[j]) :] = 0
            if pick is not None:
                gain *= pick(level, nodes)[:, j : j + 1]
            top = gain.argmax(1)
            value = gain[np.arange(nodes), top]
            better = value > best + 1e-12
            best[better] = value[better]
            where = np.flatnonzero(better)
            feature[first + where] = j
            cut[first + where] = edges[j][top[where]]
        go = np.zeros(n, bool)
        cuts, features = cut[at], feature[at]
        steps = np.array([np.searchsorted(edges[f], c, side="left") if np.isfinite(c) else BINS for f, c in zip(feature[first : first + nodes], cut[first : first + nodes], strict=True)])
        go = binned[np.arange(n), features] > steps[local]
        go &= np.isfinite(cuts)
        at = 2 * at + 1 + go
    leaf = at - inner
    value = np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + l2)
    return Tree(depth, feature, cut, value), leaf


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Isotonic:
    """Non-decreasing steps from scores to rates, fitted by pooling adjacent violators; linear between steps."""

    x: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    y: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))

    @classmethod
    def fit(cls, score: np.ndarray, label: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        xs, first = np.unique(score[order], return_index=True)
        sums = np.add.reduceat(label[order].astype(float), first)
        weights = np.diff(np.r_[first, len(order)]).astype(float)
        blocks: list[list[float]] = []  # sum, weight, first and last score
        for x, s, w in zip(xs, sums, weights, strict=True):
            blocks.append([s, w, x, x])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                s2, w2, _, hi = blocks.pop()
                blocks[-1][0] += s2
                blocks[-1][1] += w2
                blocks[-1][3] = hi
        # one more of each class keeps small blocks off 0 and 1
        x = [v for b in blocks for v in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
        y = [(b[0] + 0.5) / (b[1] + 1) for b in blocks for _ in range(2 if b[3] > b[2] else 1)]
        return cls(np.array(x), np.maximum.accumulate(np.array(y)))

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)


@dataclass
class Boosted:
    """Logistic gradient boosting; scores are calibrated on rows that the trees have not seen."""

    base: float
    trees: list[Tree]
    calibration: Isotonic = field(default_factory=Isotonic)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, least: float = 2.0, l2: float = 1.0, seed: int = 5) -> Boosted:
        y = y.astype(float)
        if len(y) == 0 or y.min() == y.max():
            rate_ = float((y.sum() + 0.5) / (len(y) + 1))
            return cls(float(np.log(rate_ / (1 - rate_))), [])
        fold = np.random.default_rng(seed).permutation(len(y)) % 4
        held = np.empty(len(y))
        for k in range(4):
            held[fold == k] = cls._boost(x[fold != k], y[fold != k], rounds, depth, rate, least, l2).raw(x[fold == k])
        model = cls._boost(x, y, rounds, depth, rate, least, l2)
        model.calibration = Isotonic.fit(held, y)
        return model

    @classmethod
    def _boost(cls, x: np.ndarray, y: np.ndarray, rounds: int, depth: int, rate: float, least: float, l2: float) -> Boosted:
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        edges = _edges(x)
        binned = _binned(x, edges)
        base = float(np.log(mean / (1 - mean)))
        f, trees = np.full(len(y), base), []
        for _ in range(rounds):
            p = _sigmoid(f)
            tree, leaf = _grow(binned, edges, y - p, p * (1 - p), depth, least / 4, l2)
            tree.value = tree.value * rate
            f += tree.value[leaf]
            trees.append(tree)
        return cls(base, trees)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree(x)
        return _sigmoid(out)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return self.calibration(raw) if self.trees else raw


@dataclass
class Forest:
    """Random forest: bootstrapped rows, a random half-power of the features at each node, mean of the leaves."""

    trees: list[Tree]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 7, seed: int = 11) -> Forest:
        rng = np.random.default_rng(seed)
        edges = _edges(x)
        binned = _binned(x, edges)
        width = x.shape[1]
        some = max(1, round(width**0.5))
        out = []
        for _ in range(trees):
            weight = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
            chosen: dict[int, np.ndarray] = {}

            def pick(level: int, nodes: int, chosen=chosen) -> np.ndarray:
                if level not in chosen:
                    chosen[level] = np.argsort(rng.random((nodes, width)), 1) < some
                return chosen[level].astype(float)

            tree, _ = _grow(binned, edges, weight * y, weight, depth, 1.0, 1e-3, pick)
            out.append(tree)
        return cls(out)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t(x) for t in self.trees], axis=0) if len(x) else np.empty(0)
