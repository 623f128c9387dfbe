"""Histogram gradient-boosted trees in numpy, flattened into arrays, and isotonic calibration.

Trees are trained on the driver from a bounded sample of labelled rows and scored inside the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Forest:
    """Complete trees of one depth in heap order: node k has the children 2k + 1 and 2k + 2."""

    depth: int
    base: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes); an unsplit node has +inf and sends all rows left
    leaf: np.ndarray  # (trees, leaves)

    def margin(self, x: np.ndarray, chunk: int = 1024) -> np.ndarray:
        """Log-odds of each row, all trees and rows of a chunk at once, level by level."""
        out = np.full(len(x), self.base)
        trees = np.arange(len(self.feature))[None, :]
        for i in range(0, len(x), chunk):
            part = x[i : i + chunk]
            rows, node = np.arange(len(part))[:, None], np.zeros((len(part), len(self.feature)), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.threshold[trees, node])
            out[i : i + chunk] += self.leaf[trees, node - (2**self.depth - 1)].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, l2: float = 2.0, least: float = 1.0, min_rows: int = 8) -> Forest:
    """Boost trees on the logistic loss. Without rows, or with one class only, the forest is a constant."""
    inner, leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if len(y) < 2 * min_rows or y.min() == y.max():
        return Forest(depth, base, np.zeros((1, inner), np.int64), np.full((1, inner), np.inf), np.zeros((1, leaves)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    n_features = x.shape[1]
    flat = binned + np.arange(n_features)[None, :] * BINS
    margin = np.full(len(y), base)
    features, thresholds, leaf_values = [], [], []
    for _ in range(trees):
        p = sigmoid(margin)
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            where = ((node - first)[:, None] * (n_features * BINS) + flat).ravel()
            shape = (width, n_features, BINS)
            sums = [np.bincount(where, np.repeat(v, n_features), minlength=width * n_features * BINS).reshape(shape).cumsum(axis=2) for v in (grad, hess, np.ones(len(y)))]
            left, total = [s[:, :, :-1] for s in sums], [s[:, :1, -1:] for s in sums]
            right = [t - s for s, t in zip(left, total, strict=True)]
            gain = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - total[0] ** 2 / (total[1] + l2)
            gain[(left[1] < least) | (right[1] < least) | (left[2] < min_rows) | (right[2] < min_rows)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            split_bin = np.full(width, BINS)
            for k in range(width):
                f, b = divmod(int(best[k]), BINS - 1)
                if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                    feature[first + k], threshold[first + k], split_bin[k] = f, cuts[f][b], b
            at = node - first
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > split_bin[at])
        at = node - inner
        g, h = np.bincount(at, grad, minlength=leaves), np.bincount(at, hess, minlength=leaves)
        value = -rate * g / (h + l2)
        margin += value[at]
        features.append(feature)
        thresholds.append(threshold)
        leaf_values.append(value)
    return Forest(depth, base, np.stack(features), np.stack(thresholds), np.stack(leaf_values))


@dataclass
class Isotonic:
    """A rising piecewise-linear map of margins to probabilities."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        # A thousandth of the plain probability keeps the order of rows that share a step.
        return 0.999 * np.interp(margin, self.at, self.value) + 0.001 * sigmoid(margin)


def isotonic(margin: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators. Each block stands at its mean margin; ends are smoothed by half a row."""
    if not len(y):
        return Isotonic(np.array([-6.0, 6.0]), sigmoid(np.array([-6.0, 6.0])))
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of margins
    for m, label in zip(margin[order], y[order], strict=True):
        blocks.append([float(label), 1.0, float(m)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return Isotonic(b[:, 2] / b[:, 1], (b[:, 0] + 0.02) / (b[:, 1] + 0.04))


def out_of_fold(x: np.ndarray, y: np.ndarray, fold: np.ndarray, **how) -> np.ndarray:
    """Margin of each row from a forest that was learnt from the rows of the other folds."""
    out = np.zeros(len(y))
    for k in np.unique(fold):
        out[fold == k] = fit(x[fold != k], y[fold != k], **how).margin(x[fold == k])
    return out
