"""Gradient-boosted trees for a yes/no target, trained here in numpy.

Trees are grown on binned features with logistic loss. A feature may be bound
to move the score only up (+1) or only down (-1): splits against it are not
taken, and the values below a split stay on their side of its middle. A trained
model is a few flat node arrays; scoring walks all rows through them at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """``root[t]`` is tree t's first node; a leaf has itself as both children."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for start in self.root:
            node = np.full(len(x), start)
            for _ in range(self.depth):
                goes_left = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(goes_left, self.left[node], self.right[node])
            score += self.value[node]
        return 1 / (1 + np.exp(-score))


def train(x: np.ndarray, y: np.ndarray, monotone: list[int], n_trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least_weight: float = 2.0) -> Trees:
    """No rows, or one class only, give a model that answers with the share of that class, smoothed by one row of each."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    nodes: list[list] = []
    roots: list[int] = []
    if 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
        binned = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)], 1)
        score = np.full(len(y), base)
        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-score))
            roots.append(_grow(nodes, binned, cuts, p - y, p * (1 - p), monotone, depth, rate, l2, least_weight, score))
    columns = list(zip(*nodes, strict=True)) if nodes else [(0,), (0.0,), (0,), (0,), (0.0,)]
    kinds = (np.int64, np.float64, np.int64, np.int64, np.float64)
    return Trees(np.array(roots, np.int64), *(np.array(c, k) for c, k in zip(columns, kinds, strict=True)), base, depth)


def _grow(nodes, binned, cuts, gradient, hessian, monotone, depth, rate, l2, least_weight, score) -> int:
    """Append one tree to ``nodes``, add its answers to ``score`` and return its root."""

    def leaf(rows, low, high) -> float:
        return float(np.clip(-gradient[rows].sum() / (hessian[rows].sum() + l2), low, high))

    def best_split(rows, low, high):
        g_all, h_all = gradient[rows].sum(), hessian[rows].sum()
        found = (1e-9, None)
        for f, own in enumerate(cuts):
            if not len(own):
                continue
            g = np.cumsum(np.bincount(binned[rows, f], gradient[rows], len(own) + 1))[:-1]
            h = np.cumsum(np.bincount(binned[rows, f], hessian[rows], len(own) + 1))[:-1]
            a, b = np.clip(-g / (h + l2), low, high), np.clip(-(g_all - g) / (h_all - h + l2), low, high)
            gain = g**2 / (h + l2) + (g_all - g) ** 2 / (h_all - h + l2) - g_all**2 / (h_all + l2)
            allowed = (h >= least_weight) & (h_all - h >= least_weight) & ((b - a) * monotone[f] >= 0)
            gain = np.where(allowed, gain, -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > found[0]:
                found = (float(gain[k]), (f, k, float(a[k]), float(b[k])))
        return found[1]

    def build(rows, level, low, high) -> int:
        me = len(nodes)
        nodes.append([0, 0.0, me, me, 0.0])
        split = best_split(rows, low, high) if level < depth else None
        if split is None:
            value = rate * leaf(rows, low, high)
            nodes[me][4] = value
            score[rows] += value
            return me
        f, k, a, b = split
        middle = (a + b) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[monotone[f]]
        goes_left = binned[rows, f] <= k
        nodes[me][:2] = [f, float(cuts[f][k])]
        nodes[me][2] = build(rows[goes_left], level + 1, *bounds[0])
        nodes[me][3] = build(rows[~goes_left], level + 1, *bounds[1])
        return me

    return build(np.arange(len(gradient)), 0, -np.inf, np.inf)
