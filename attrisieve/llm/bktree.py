"""Burkhard-Keller trees over binary codes, many trees at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Forest:
    """One tree per shard; a child hangs at its Hamming distance to its parent.

    ``shard`` (any integers, equal values adjacent) and ``codes`` (uint64, one or several words a code) are parallel; the first
    code of a shard is its root. Insertion and search move all codes one level at a time.
    """

    def __init__(self, shard: np.ndarray, codes: np.ndarray):
        n = len(codes)
        self.codes = codes.reshape(n, -1)
        keys = 64 * self.codes.shape[1] + 1
        child = np.full(n * keys, -1, dtype=np.int32)
        starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.zeros(0, dtype=np.int64)
        self.shards, self.roots = shard[starts], starts
        self.largest = int(np.diff(np.r_[starts, n]).max()) if n else 0
        at = np.repeat(starts, np.diff(np.r_[starts, n]))
        active = np.flatnonzero(at != np.arange(n))
        at = at[active]
        parent, key = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int16)
        while active.size:
            gap = self.apart(self.codes[active], at)
            slot = at * keys + gap
            free = np.flatnonzero(child[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            child[slot[placed]] = active[placed]
            parent[active[placed]], key[active[placed]] = at[placed], gap[placed]
            stay = np.ones(active.size, dtype=bool)
            stay[placed] = False
            at = child[slot[stay]].astype(np.int64)
            active = active[stay]
        # children of a node, one behind another
        hung = np.flatnonzero(parent >= 0)
        self.children = hung[np.argsort(parent[hung], kind="stable")]
        self.many = np.bincount(parent[hung], minlength=n)
        self.first = np.cumsum(self.many) - self.many
        self.key = key[self.children].astype(np.int64)

    def apart(self, codes: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Hamming distances of codes to nodes, row by row."""
        gap = np.bitwise_count(codes[:, 0] ^ self.codes[node, 0]).astype(np.int64)
        for k in range(1, self.codes.shape[1]):
            gap += np.bitwise_count(codes[:, k] ^ self.codes[node, k])
        return gap

    def search(self, shard: np.ndarray, codes: np.ndarray, radius: int, room: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yield (index into codes, index of node) of all pairs within the radius, following only edges within it."""
        if not len(self.shards):
            return
        codes = codes.reshape(len(codes), -1)
        where = np.minimum(np.searchsorted(self.shards, shard), len(self.shards) - 1)
        known = np.flatnonzero(self.shards[where] == shard)
        block = max(16, room // max(1, self.largest))
        for start in range(0, known.size, block):
            probe = known[start : start + block]
            node = self.roots[where[probe]]
            while probe.size:
                gap = self.apart(codes[probe], node)
                hit = gap <= radius
                yield probe[hit], node[hit]
                many = self.many[node]
                source = np.repeat(np.arange(probe.size), many)
                place = np.repeat(self.first[node] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                follow = np.abs(self.key[place] - gap[source]) <= radius
                probe, node = probe[source[follow]], self.children[place[follow]]


def roots_of(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """The smallest node reachable from each of n nodes over the edges (a, b), and over those already in parent."""
    parent = np.arange(n) if parent is None else parent
    while a.size:
        x, y = parent[a], parent[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = parent[parent]
            if (further == parent).all():
                break
            parent = further
    return parent
