"""Gradient-boosted oblivious trees for few classes, in numpy.

All nodes of a tree's level share one test, so a tree is a table of 2^depth leaves and predicting is a
few comparisons for all rows at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Fitted trees: per round and class the features, limits and leaf values."""

    classes: int
    base: np.ndarray
    trees: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """``x`` has a row per feature. Returns a row per class."""
        score = np.repeat(self.base[:, None], x.shape[1], axis=1)
        for c, features, limits, values in self.trees:
            leaf = np.zeros(x.shape[1], np.int64)
            for level, (f, limit) in enumerate(zip(features, limits)):
                leaf |= (x[f] > limit).astype(np.int64) << level
            score[c] += values[leaf]
        score -= score.max(axis=0)
        return score - np.log(np.exp(score).sum(axis=0))


def fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 30, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 2.0) -> Trees:
    """Boost softmax trees on ``x`` (a row per feature) by second-order gains over binned features."""
    limits = [np.unique(np.quantile(row, np.linspace(0, 1, bins + 1)[1:-1])) for row in x]
    coded = np.stack([np.searchsorted(edges, row, side="left") for edges, row in zip(limits, x)])
    share = np.bincount(y, minlength=classes) + 1.0
    out = Trees(classes, np.log(share / share.sum()))
    score = np.repeat(out.base[:, None], x.shape[1], axis=1)
    target = np.eye(classes)[y].T
    for _ in range(rounds):
        p = np.exp(score - score.max(axis=0))
        p /= p.sum(axis=0)
        for c in range(classes):
            g, h = target[c] - p[c], np.maximum(p[c] * (1 - p[c]), 1e-6)
            leaf = np.zeros(x.shape[1], np.int64)
            features, cuts = [], []
            for level in range(depth):
                best = (-np.inf, 0, 0)
                for f, row in enumerate(coded):
                    if not len(limits[f]):
                        continue
                    key = leaf * bins + row
                    hg = np.bincount(key, g, (1 << level) * bins).reshape(-1, bins).cumsum(axis=1)
                    hh = np.bincount(key, h, (1 << level) * bins).reshape(-1, bins).cumsum(axis=1)
                    left = (hg**2 / (hh + ridge) + (hg[:, -1:] - hg) ** 2 / (hh[:, -1:] - hh + ridge)).sum(axis=0)[: len(limits[f])]
                    i = int(left.argmax())
                    if left[i] > best[0]:
                        best = (left[i], f, i)
                _, f, i = best
                features.append(f)
                cuts.append(limits[f][i])
                leaf |= (coded[f] > i).astype(np.int64) << level
            sums = np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + ridge)
            values = rate * sums
            score[c] += values[leaf]
            out.trees.append((c, np.array(features), np.array(cuts), values))
    return out
