"""Forests of BK-trees over fingerprints of 64 bits or several such words, built and searched level by level in numpy.

A node's children are keyed by their integer Hamming distance to it. A search from a node at
distance ``d`` follows only the edges ``d - radius .. d + radius``: by the triangle inequality
no other subtree holds a match. Many small trees (one per shard) are handled at once.
"""

from __future__ import annotations

import numpy as np

#: Most (query, node) pairs that a search holds at once, by an upper bound from shard sizes.
FRONTIER = 1 << 22


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of the rows of two uint64 matrices."""
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


class BKForest:
    """One BK-tree for each run of equal ``shard`` (values within a shard are distinct)."""

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        n = len(values)
        self.values = values = values.reshape(n, -1) if n else values.reshape(0, 1)
        # One more than the largest distance, so that (node, edge) packs into one integer.
        self.edges = 64 * values.shape[1] + 1
        head = np.r_[True, shard[1:] != shard[:-1]] if n else np.zeros(0, bool)
        starts = np.flatnonzero(head)
        self.size = np.diff(np.r_[starts, n])[np.cumsum(head) - 1] if n else np.zeros(0, np.int64)
        self.root = starts[np.cumsum(head) - 1] if n else np.zeros(0, np.int64)
        key = np.full(n, -1, np.int64)
        nodes, group = np.arange(n), shard
        while len(nodes):
            first = np.r_[True, group[1:] != group[:-1]]
            parents = nodes[first][np.cumsum(first) - 1][~first]
            nodes = nodes[~first]
            group = parents * self.edges + distance(values[nodes], values[parents])
            key[nodes] = group  # the last one stands: a node stops moving when it heads a group
            order = np.argsort(group, kind="stable")
            nodes, group = nodes[order], group[order]
        self.children = np.argsort(key, kind="stable")
        self.keys = key[self.children]

    def _chunks(self):
        total = np.cumsum(self.size)
        begin = 0
        while begin < len(self.values):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + FRONTIER, "right")))
            yield np.arange(begin, min(end, len(self.values)))
            begin = end

    def links(self, radius: int):
        """Yield arrays ``(i, j)`` of the pairs within ``radius``, ``i`` before ``j``, in blocks."""
        for query in self._chunks():
            node = self.root[query]
            while len(query):
                d = distance(self.values[query], self.values[node])
                hit = (d <= radius) & (node < query)
                if hit.any():
                    yield node[hit], query[hit]
                low = np.searchsorted(self.keys, node * self.edges + np.maximum(d - radius, 0), "left")
                many = np.searchsorted(self.keys, node * self.edges + np.minimum(d + radius, self.edges - 1), "right") - low
                at = np.arange(many.sum()) + np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many)
                node, query = self.children[at], np.repeat(query, many)


def roots(n: int, pairs) -> np.ndarray:
    """Least index of each node's component, for an iterable of arrays ``(i, j)``."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = label[a], label[b]
            off = x != y
            if not off.any():
                break
            a, b, x, y = a[off], b[off], x[off], y[off]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    return label
