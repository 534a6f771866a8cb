"""A packed R-tree over count vectors, and the sets in it that are similar enough.

A set of hashes becomes a point: how many of its hashes fall in each of ``GROUPS`` equal parts of
the hash range. Two sets share at most the sum of the smaller counts; a node of the tree
keeps the largest counts and the range of sizes below it, so the same sum bounds whole subtrees.
"""

from __future__ import annotations

import numpy as np

GROUPS = 64
LEAF = 16
FAN = 8
CELLS = 1 << 21


def count_vectors(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``GROUPS`` counts per sorted set of uint64 hashes."""
    edges = (np.arange(1, GROUPS, dtype=np.uint64)) << np.uint64(64 - 6)
    out = np.zeros((len(sets), GROUPS), np.int32)
    for i, hashes in enumerate(sets):
        out[i] = np.diff(np.concatenate(([0], np.searchsorted(hashes, edges), [len(hashes)])))
    return out


class CountTree:
    """Points in size order, then by their counts, in leaves of ``LEAF`` and nodes of ``FAN``."""

    def __init__(self, points: np.ndarray):
        sizes = points.sum(axis=1)
        self.order = np.lexsort((*points.T[:4], sizes))
        self.levels = []
        top, low, high = points[self.order], sizes[self.order], sizes[self.order]
        self.points, self.sizes = top, low
        fan = LEAF
        while len(top) > 1:
            heads = np.arange(0, len(top), fan)
            top = np.maximum.reduceat(top, heads, axis=0)
            low, high = np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads)
            self.levels.append((fan, top, low, high))
            fan = FAN

    def pairs(self, numerator: int, denominator: int):
        """Index pairs whose bound allows similarity ``numerator/denominator``, in bounded blocks.

        Yields (i, j) arrays of positions in the given points; each pair comes once.
        """
        n = len(self.points)
        for start in range(0, n, 256):
            query = np.arange(start, min(start + 256, n))
            yield from self._descend(query, np.zeros(len(query), np.int64), len(self.levels) - 1, numerator, denominator)

    def _descend(self, query, node, level, num, den):
        step = max(1, CELLS // GROUPS)
        for at in range(0, len(query), step):
            q, v = query[at : at + step], node[at : at + step]
            if level < 0:
                keep = v > q
                q, v = q[keep], v[keep]
                bound, low = self._overlap(q, self.points[v]), self.sizes[v]
                high = low
            else:
                _, top, lows, highs = self.levels[level]
                bound, low, high = self._overlap(q, top[v]), lows[v], highs[v]
            size = self.sizes[q]
            # overlap / (both - overlap) >= num / den, and the smaller size over the larger too
            good = (bound * (num + den) >= num * (size + low)) & (high * den >= num * size) & (size * den >= num * low)
            q, v = q[good], v[good]
            if not len(q):
                continue
            if level < 0:
                yield self.order[q], self.order[v]
                continue
            fan = self.levels[level][0]
            below = len(self.points) if level == 0 else len(self.levels[level - 1][1])
            child = v[:, None] * fan + np.arange(fan)
            inside = child < below
            yield from self._descend(np.repeat(q, fan)[inside.ravel()], child[inside], level - 1, num, den)

    def _overlap(self, q, other):
        return np.minimum(self.points[q], other).sum(axis=1, dtype=np.int64)


def fine_counts(hashes: np.ndarray) -> np.ndarray:
    """Counts of a set of uint64 hashes in ``GROUPS`` equal parts, or so many times two that they hold 16 on average at most."""
    bits = 6 + max(0, (len(hashes) - 1).bit_length() - 10)
    return np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.int32)


def may_link(points: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the counts of two sets, in the coarser of their two resolutions, allow similarity ``num/den``."""
    width = np.array([len(p) for p in points])
    size = np.array([p.sum() for p in points], np.int64)
    common = np.minimum(width[left], width[right])
    good = np.minimum(size[left], size[right]) * den >= num * np.maximum(size[left], size[right])
    for groups in np.unique(common[good]).tolist():
        pairs = np.flatnonzero(good & (common == groups))
        step = max(1, CELLS // groups)
        for at in range(0, len(pairs), step):
            own = pairs[at : at + step]
            rows, place = np.unique(np.concatenate((left[own], right[own])), return_inverse=True)
            folded = np.array([points[i].reshape(groups, -1).sum(axis=1) for i in rows.tolist()])
            bound = np.minimum(folded[place[: len(own)]], folded[place[len(own) :]]).sum(axis=1, dtype=np.int64)
            good[own] = bound * (num + den) >= num * (size[left[own]] + size[right[own]])
    return good


def allowed_forest(points: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph of pairs whose counts allow similarity ``num/den``."""
    parent = np.arange(len(points))
    found = []
    for left, right in CountTree(np.array([p.reshape(GROUPS, -1).sum(axis=1) for p in points])).pairs(num, den):
        while (parent[parent] != parent).any():
            parent = parent[parent]
        apart = parent[left] != parent[right]
        left, right = left[apart], right[apart]
        good = may_link(points, left, right, num, den)
        for i, j in zip(left[good].tolist(), right[good].tolist()):
            a, b = i, j
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            if a != b:
                parent[a] = b
                found.append((i, j))
    return found


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def linked(sets: list[np.ndarray], num: int, den: int, same_side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the graph of pairs with similarity of ``num/den`` or more.

    Pairs already joined by found links are not verified again: the components are the same.
    ``same_side`` numbers two halves, and only pairs across them are looked for.
    """
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found = []
    for left, right in CountTree(count_vectors(sets)).pairs(num, den):
        if same_side is not None:
            across = same_side[left] != same_side[right]
            left, right = left[across], right[across]
        for i, j in zip(left.tolist(), right.tolist()):
            a, b = root(i), root(j)
            if a != b:
                shared = overlap(sets[i], sets[j])
                if shared * den >= num * (len(sets[i]) + len(sets[j]) - shared):
                    parent[a] = b
                    found.append((i, j))
    return found
