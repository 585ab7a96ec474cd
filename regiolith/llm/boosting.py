"""Gradient-boosted trees for a logistic loss, and isotonic calibration, on small arrays."""

from __future__ import annotations

import numpy as np

BINS = 64


class Boosted:
    """Trees of fixed depth over binned features; a tree is arrays of (feature, threshold) by node and values by leaf."""

    def __init__(self, edges: list[np.ndarray], trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], start: float) -> None:
        self.edges, self.trees, self.start = edges, trees, start

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 120, depth: int = 3, rate: float = 0.12, ridge: float = 2.0, least: float = 5.0) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
        share = np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6)
        out = cls(edges, [], float(np.log(share / (1 - share))))
        score = np.full(len(y), out.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p)
            feature, cut, node = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, BINS), np.zeros(len(y), np.int64)
            for level in range(depth):
                width, first = 1 << level, (1 << level) - 1
                best = np.zeros(width)
                total_g, total_h = np.bincount(node, g, width), np.bincount(node, h, width)
                for f in range(x.shape[1]):
                    key = node * BINS + binned[:, f]
                    left_g, left_h = (np.bincount(key, v, width * BINS).reshape(width, BINS).cumsum(axis=1) for v in (g, h))
                    right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - (total_g**2 / (total_h + ridge))[:, None]
                    gain[(left_h < least / 4) | (right_h < least / 4)] = 0
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(width), at]
                    better = top > best + 1e-9
                    best[better] = top[better]
                    feature[first : first + width][better], cut[first : first + width][better] = f, at[better]
                node = node * 2 + (binned[np.arange(len(y)), feature[first + node]] > cut[first + node])
            value = rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + ridge)
            score += value[node]
            out.trees.append((feature, cut, value))
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], axis=1)
        score, row = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < len(feature):
                node = 2 * node + 1 + (binned[row, feature[node]] > cut[node])
            score += value[node - len(feature)]
        return score


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted non-decreasing fit of y on x, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # weight, weighted sum, x sum
    for a, b, w in zip(x[order], y[order], weight[order]):
        blocks.append([w, w * b, w * a])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])
