"""Isolation forest with range checks, vectorised over all trees at once.

Every tree is a complete binary tree of fixed depth held in flat arrays. Trees
are shared out among groups of features, and a tree draws from its group's
features only: a reading that is odd in one respect is isolated by the trees of
that group, however ordinary the rest of it is. At a node one feature and a cut
between the smallest and largest value of the node's sample are drawn. A scored
point that lies outside the node's acceptable range (the sample's range widened by
half of itself, at least by ``FLOOR``) counts as isolated there and goes no deeper;
so a feature that is constant in the sample still separates points that break
the constancy.

What the forest is fitted on holds faults too. Points of the pool that a wide gap
sets off are left out, and points that a first forest isolates, after which it is
fitted again, up to three times.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

TREES, DEPTH, SAMPLE = 12, 7, 128
FLOOR = 8.0
EULER = 0.5772156649015329
#: The share of a pool that may be faults which look alike.
FEW = 0.05
#: Mean depth of an unsuccessful search among SAMPLE points, by which depths are measured.
ORDINARY = 2.0 * (np.log(SAMPLE - 1.0) + EULER) - 2.0 * (SAMPLE - 1.0) / SAMPLE


def expected_depth(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` points, the correction for unsplit leaves."""
    n = np.asarray(n, dtype=float)
    m = np.maximum(n, 2.0)
    return np.where(n > 2, 2.0 * (np.log(m - 1.0) + EULER) - 2.0 * (m - 1.0) / m, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Fitted on ``pool`` (rows x features, finite); ``seed`` fixes every draw, ``groups`` lists the features of each group."""

    def __init__(self, pool: np.ndarray, seed: int, groups: Sequence[Sequence[int]] | None = None, trees: int = TREES, depth: int = DEPTH, sample: int = SAMPLE):
        rng = np.random.default_rng(seed)
        rows, width = pool.shape
        groups = groups or [range(width)]
        take = min(sample, rows)
        count = trees * len(groups)
        picks = rng.random((count, rows)).argpartition(take - 1, axis=1)[:, :take] if rows > take else np.tile(np.arange(rows), (count, 1))
        inner = 2**depth - 1
        self.depth, self.trees, self.groups = depth, trees, len(groups)
        self.feature = np.concatenate([np.asarray(g)[rng.integers(0, len(g), (trees, inner))] for g in groups])
        self.cut, self.low, self.high = (np.zeros((count, inner)) for _ in range(3))
        draws = rng.random((count, inner))
        tree = np.repeat(np.arange(count), take)
        flat = pool[picks].reshape(count * take, width)
        node = np.zeros(count * take, dtype=np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            value = flat[np.arange(len(flat)), self.feature[tree, first + node]]
            slot = tree * wide + node
            low, high = np.full(count * wide, np.inf), np.full(count * wide, -np.inf)
            np.minimum.at(low, slot, value)
            np.maximum.at(high, slot, value)
            empty = low > high
            low[empty], high[empty] = -np.inf, np.inf
            span = np.where(empty, 0.0, high - low)
            cut = np.where(empty, 0.0, low + draws[:, first : first + wide].ravel() * span)
            cut = np.where(span > 0, cut, np.inf)
            room = np.maximum(0.5 * span, FLOOR)
            at = slice(first, first + wide)
            self.cut[:, at], self.low[:, at], self.high[:, at] = (x.reshape(count, wide) for x in (cut, low - room, high + room))
            node = node * 2 + (value >= cut[slot])
        leaf = np.bincount(tree * 2**depth + node, minlength=count * 2**depth).reshape(count, 2**depth)
        self.leaf = depth + expected_depth(leaf)

    def scores(self, points: np.ndarray) -> np.ndarray:
        """Per point and group 2 ** (-mean depth / ORDINARY): near 1 is anomalous, below 0.6 is ordinary."""
        n = len(points)
        at = np.arange(n)
        total = np.zeros((n, self.groups))
        for t in range(self.trees * self.groups):
            node = np.zeros(n, dtype=np.int64)
            depth = np.zeros(n)
            live = np.ones(n, dtype=bool)
            for level in range(self.depth):
                here = 2**level - 1 + node
                value = points[at, self.feature[t, here]]
                out = live & ((value < self.low[t, here]) | (value > self.high[t, here]))
                depth[out] = level + 1
                live &= ~out
                node = node * 2 + (value >= self.cut[t, here])
            total[:, t // self.trees] += np.where(live, self.leaf[t, node], depth)
        return 2.0 ** (-total / self.trees / ORDINARY)

    def score(self, points: np.ndarray) -> np.ndarray:
        """The score of the group that sets a point most apart."""
        return self.scores(points).max(axis=1) if len(points) else np.zeros(0)


def set_off(pool: np.ndarray) -> np.ndarray:
    """Points with a value beyond a gap of more than FLOOR behind which at most FEW of the pool lie."""
    apart = np.zeros(len(pool), dtype=bool)
    few = max(1, int(FEW * len(pool)))
    for x in (*pool.T, *-pool.T):
        high = np.sort(x)[-few - 1 :]
        at = np.flatnonzero(np.diff(high) > FLOOR)
        if len(at) and len(pool) > few:
            apart |= x > high[at[0]]
    return apart


def cleaned(pool: np.ndarray, seed: int, groups: Sequence[Sequence[int]], odd: float, rounds: int = 3) -> Forest:
    """A forest on ``pool`` without what is set off and without what the forests before it score at ``odd`` or more, as long as half of it is left."""
    kept = pool[~set_off(pool)]
    for k in range(rounds):
        forest = Forest(kept, seed + k, groups)
        sound = forest.score(kept) < odd
        if sound.all() or 2 * np.count_nonzero(sound) < len(pool):
            break
        kept = kept[sound]
    return forest
