"""Gradient-boosted trees for several classes, on binned features, in numpy.

Small enough to travel in a task's closure; trained on the driver from a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """A complete binary tree of ``depth`` levels: split feature and bin of each inner node, value of each leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaves(self, binned: np.ndarray) -> np.ndarray:
        at = np.zeros(len(binned), dtype=np.int64)
        inner = len(self.feature)
        while inner and at[0] < inner if len(at) else False:
            at = 2 * at + 1 + (binned[np.arange(len(binned)), self.feature[at]] > self.cut[at])
        return at - inner


@dataclass
class BoostedTrees:
    """Softmax boosting with shrinkage and second-order leaf values."""

    classes: int
    rounds: int = 60
    depth: int = 4
    rate: float = 0.15
    bins: int = 64
    ridge: float = 1.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[list[Tree]] = field(default_factory=list)
    prior: np.ndarray | None = None

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        n, width = x.shape
        weight = np.ones(n) if weight is None else weight
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        binned = self._bin(x)
        onehot = np.eye(self.classes)[y]
        share = (onehot * weight[:, None]).sum(0) + 1.0
        self.prior = np.log(share / share.sum())
        scores = np.tile(self.prior, (n, 1))
        for _ in range(self.rounds):
            p = np.exp(scores - scores.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            stage = []
            for k in range(self.classes):
                tree = self._grow(binned, (onehot[:, k] - p[:, k]) * weight, np.maximum(p[:, k] * (1 - p[:, k]), 1e-6) * weight)
                scores[:, k] += tree.value[tree.leaves(binned)]
                stage.append(tree)
            self.trees.append(stage)
        return self

    def _grow(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> Tree:
        n, width = binned.shape
        size = self.bins + 1
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, size, dtype=np.int64)
        at = np.zeros(n, dtype=np.int64)
        offset = np.arange(width) * size
        for level in range(self.depth):
            first, count = 2**level - 1, 2**level
            flat = ((at - first)[:, None] * (width * size) + offset + binned).ravel()
            g = np.bincount(flat, np.repeat(grad, width), count * width * size).reshape(count, width, size).cumsum(2)
            h = np.bincount(flat, np.repeat(hess, width), count * width * size).reshape(count, width, size).cumsum(2)
            all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + self.ridge) + (all_g - g) ** 2 / (all_h - h + self.ridge) - all_g**2 / (all_h + self.ridge)
            gain[(h < 1e-3) | (all_h - h < 1e-3)] = 0
            best = gain.reshape(count, -1).argmax(1)
            useful = gain.reshape(count, -1)[np.arange(count), best] > 1e-9
            feature[first : first + count] = np.where(useful, best // size, 0)
            cut[first : first + count] = np.where(useful, best % size, size)
            at = 2 * at + 1 + (binned[np.arange(n), feature[at]] > cut[at])
        leaf = at - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        return Tree(feature, cut, self.rate * g / (h + self.ridge))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Raw class scores of every row."""
        if not len(x):
            return np.zeros((0, self.classes))
        binned = self._bin(x)
        out = np.tile(self.prior, (len(x), 1))
        for stage in self.trees:
            for k, tree in enumerate(stage):
                out[:, k] += tree.value[tree.leaves(binned)]
        return out


@dataclass
class Calibration:
    """Multinomial logistic map from raw scores to probabilities, fitted on a hand-checked holdout."""

    weight: np.ndarray
    bias: np.ndarray

    @classmethod
    def fit(cls, scores: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.2, ridge: float = 1e-3) -> Calibration:
        k = scores.shape[1]
        weight, bias = np.full(k, 0.5), np.zeros(k)
        onehot = np.eye(k)[y]
        for _ in range(steps if len(y) else 0):
            p = cls(weight, bias).probabilities(scores)
            error = (p - onehot) / len(y)
            weight = weight - rate * ((error * scores).sum(0) + ridge * (weight - 0.5))
            bias = bias - rate * (error.sum(0) + ridge * bias)
        return cls(weight, bias)

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        z = scores * self.weight + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
