"""Burkhard-Keller trees over fingerprints of 64-bit words, built and searched level by level.

A forest holds one tree per group.  Below a node, the child on edge d holds all
points at Hamming distance exactly d from the node, so a search at distance x
from the node follows only the edges x - r to x + r.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Bound of (query, node) visits held at once.
FRONTIER = 500_000
# More than any distance.
EDGES = 512


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers start .. start + count - 1 of every span, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; fingerprints are one word, or a row of at most seven."""
    bits = np.bitwise_count(a ^ b)
    return bits.astype(np.int64) if bits.ndim == 1 else bits.sum(axis=1, dtype=np.int64)


class Forest:
    def __init__(self, points: np.ndarray, groups: np.ndarray, count: int):
        """``points`` are unsigned 64-bit, one or a row of them; ``groups`` numbers the tree of each, below ``count``."""
        self.points = points
        self.roots = np.full(count, -1, dtype=np.int64)
        self.sizes = np.bincount(groups, minlength=len(self.roots))
        left, slot = np.arange(len(points)), groups.astype(np.int64)
        parent = np.full(len(points), -1, dtype=np.int64)
        edge = np.zeros(len(points), dtype=np.int64)
        above = np.full(len(self.roots), -1, dtype=np.int64)
        distance = np.zeros(len(self.roots), dtype=np.int64)
        first_level = True
        while len(left):
            _, first, slot = np.unique(slot, return_index=True, return_inverse=True)
            nodes = left[first]
            if first_level:
                self.roots[groups[nodes]] = nodes
                first_level = False
            else:
                parent[nodes], edge[nodes] = above[first], distance[first]
            rest = np.ones(len(left), dtype=bool)
            rest[first] = False
            above, left = nodes[slot][rest], left[rest]
            distance = hamming(points[left], points[above])
            slot = above * EDGES + distance
        child = np.flatnonzero(parent >= 0)
        key = parent[child] * EDGES + edge[child]
        order = np.argsort(key, kind="stable")
        self.child, self.key = child[order], key[order]

    def within(self, points: np.ndarray, groups: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (query index, point index) at distance ``radius`` or less, each in its own tree."""
        cost = np.cumsum(self.sizes[groups])
        at = 0
        while at < len(points):
            done = cost[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(cost, done + FRONTIER, side="right")))
            query, node = np.arange(at, to), self.roots[groups[at:to]]
            while len(query):
                distance = hamming(points[query], self.points[node])
                hit = distance <= radius
                yield query[hit], node[hit]
                low = np.searchsorted(self.key, node * EDGES + np.maximum(distance - radius, 0))
                high = np.searchsorted(self.key, node * EDGES + np.minimum(distance + radius, EDGES - 1), side="right")
                query, node = np.repeat(query, high - low), self.child[spans(low, high - low)]
            at = to


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a[i] with b[i]; each label is the smallest index of its class."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low = np.minimum(la, lb)
        np.minimum.at(label, np.maximum(la, lb), low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def spanning_forest(count: int, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indexes of the links of a minimum spanning forest of ``count`` points, by rounds of nearest other components."""
    label, kept = np.arange(count), []
    open_ = np.arange(len(a))
    while True:
        la, lb = label[a[open_]], label[b[open_]]
        cross = la != lb
        open_, la, lb = open_[cross], la[cross], lb[cross]
        if not len(open_):
            return np.concatenate(kept) if kept else np.zeros(0, dtype=np.int64)
        # A total order of the links, so that no round closes a circle.
        order = np.empty(len(open_), dtype=np.int64)
        order[np.lexsort((open_, length[open_]))] = np.arange(len(open_))
        best = np.full(count, len(open_))
        np.minimum.at(best, la, order)
        np.minimum.at(best, lb, order)
        chosen = np.flatnonzero(np.isin(order, best[best < len(open_)]))
        kept.append(open_[chosen])
        label = merge_labels(label, a[open_[chosen]], b[open_[chosen]])
