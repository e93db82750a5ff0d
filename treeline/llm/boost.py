"""Gradient-boosted trees and isotonic calibration in NumPy, for training sets of bounded size."""

from __future__ import annotations

import numpy as np


class Trees:
    """Boosted depth-limited trees for log loss, on binned features."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, leaf: float = 3.0, reg: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.leaf, self.reg = rounds, depth, rate, bins, leaf, reg

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        width = self.bins + 1
        # equal rows count as one with their weights' sum
        both, at = np.unique(np.column_stack([b, y]).astype(np.int16), axis=0, return_inverse=True)
        w = np.bincount(at.ravel(), weights=w)
        b, y = both[:, :-1].astype(int), both[:, -1].astype(float)
        base = np.clip(np.average(y, weights=w), 1e-3, 1 - 1e-3)
        self.base = float(np.log(base / (1 - base)))
        score, self.trees = np.full(len(y), self.base), []
        n_f = b.shape[1]
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = w * (p - y), w * p * (1 - p)
            size = 2 ** (self.depth + 1)
            feat, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
            node = np.ones(len(y), int)
            for level in range(self.depth):
                for k in range(2**level, 2 ** (level + 1)):
                    at = np.flatnonzero(node == k)
                    if len(at) < 2 or w[at].sum() < 2 * self.leaf:
                        continue
                    flat = (b[at] + np.arange(n_f) * width).ravel()
                    gs = np.bincount(flat, np.repeat(g[at], n_f), n_f * width).reshape(n_f, width).cumsum(1)
                    hs = np.bincount(flat, np.repeat(h[at], n_f), n_f * width).reshape(n_f, width).cumsum(1)
                    ws = np.bincount(flat, np.repeat(w[at], n_f), n_f * width).reshape(n_f, width).cumsum(1)
                    gt, ht, wt = gs[:, -1:], hs[:, -1:], ws[:, -1:]
                    gain = gs**2 / (hs + self.reg) + (gt - gs) ** 2 / (ht - hs + self.reg) - gt**2 / (ht + self.reg)
                    gain[(ws < self.leaf) | (wt - ws < self.leaf)] = 0
                    best = int(gain.argmax())
                    f, c = divmod(best, width)
                    if gain[f, c] <= 1e-6:
                        continue
                    feat[k], cut[k] = f, c
                    node[at] = 2 * k + (b[at, f] > c)
            for k in np.unique(node):
                at = node == k
                value[k] = -self.rate * g[at].sum() / (h[at].sum() + self.reg)
            score += value[node]
            self.trees.append((feat, cut, value))
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        b = self._binned(x)
        rows, score = np.arange(len(x)), np.full(len(x), self.base)
        for feat, cut, value in self.trees:
            node = np.ones(len(x), int)
            for _ in range(self.depth):
                f = feat[node]
                inner = f >= 0
                node = np.where(inner, 2 * node + (b[rows, np.maximum(f, 0)] > cut[node]), node)
            score += value[node]
        return score


def isotonic(score: np.ndarray, y: np.ndarray, w: np.ndarray, prior: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability) of the non-decreasing fit. Each pool is drawn to the mean by ``prior``
    weight, so that one or two observations alone decide nothing."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v, k in zip(score[order], y[order], w[order]):
        blocks.append([s, s, v * k, k])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            _, hi, a, b = blocks.pop()
            blocks[-1][1] = hi
            blocks[-1][2] += a
            blocks[-1][3] += b
    xs = np.array([x for lo, hi, _, _ in blocks for x in (lo, hi)])
    mean = float(np.average(y, weights=w))
    ys = np.array([(a + prior * mean) / (b + prior) for _, _, a, b in blocks for _ in (0, 1)])
    return xs, np.maximum.accumulate(ys)
