"""A graph in arrays, and the state of one crawl of it with features kept up to date."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Csr:
    """ids: sorted node ids; the neighbours of node i (by position) are indices[indptr[i]:indptr[i + 1]], sorted; y: 1, 0 or -1 for no label."""

    ids: np.ndarray
    indptr: np.ndarray
    indices: np.ndarray
    y: np.ndarray

    @classmethod
    def build(cls, src: np.ndarray, dst: np.ndarray, labels: dict[int, int] | None = None) -> Csr:
        ids = np.unique(np.concatenate([src, dst]))
        a, b = np.searchsorted(ids, src), np.searchsorted(ids, dst)
        real = a != b
        pairs = np.unique(np.stack([np.concatenate([a[real], b[real]]), np.concatenate([b[real], a[real]])], 1), axis=0) if real.any() else np.zeros((0, 2), np.int64)
        indptr = np.searchsorted(pairs[:, 0], np.arange(len(ids) + 1))
        y = np.array([-1 if labels is None else labels.get(int(i), -1) for i in ids], np.int8)
        return cls(ids, indptr, pairs[:, 1].copy(), y)

    def near(self, v: int) -> np.ndarray:
        return self.indices[self.indptr[v] : self.indptr[v + 1]]

    def degree(self, v: int) -> int:
        return int(self.indptr[v + 1] - self.indptr[v])


class Crawl:
    """What a crawl knows: crawled and observed nodes, and for each node its visible degree, triangles, crawled and target neighbours.

    An edge is visible if an end is crawled. Counts are whole numbers, so the features equal their closed forms exactly.
    """

    def __init__(self, graph: Csr):
        n = len(graph.ids)
        self.graph = graph
        self.crawled = np.zeros(n, bool)
        self.observed: set[int] = set()
        self.degree, self.triangles, self.crawled_near, self.targets_near = (np.zeros(n, np.int64) for _ in range(4))
        self.order: list[int] = []

    def observe(self, v: int) -> None:
        if not self.crawled[v]:
            self.observed.add(v)

    def crawl(self, v: int) -> list[int]:
        """Crawl a node; returns the newly observed ones in ascending order. A crawled node changes nothing."""
        if self.crawled[v]:
            return []
        near = self.graph.near(v)
        fresh = near[~self.crawled[near]]
        old = near[self.crawled[near]]
        for u in fresh.tolist():
            shared = old[np.isin(old, self.graph.near(u), assume_unique=True)]
            if len(shared):
                self.triangles[u] += len(shared)
                self.triangles[v] += len(shared)
                self.triangles[shared] += 1
        self.degree[fresh] += 1
        self.degree[v] += len(fresh)
        self.crawled_near[near] += 1
        if self.graph.y[v] == 1:
            self.targets_near[near] += 1
        self.crawled[v] = True
        self.order.append(v)
        self.observed.discard(v)
        new = [u for u in fresh.tolist() if u not in self.observed]
        self.observed.update(new)
        return new

    def visible(self, v: int) -> np.ndarray:
        near = self.graph.near(v)
        return near if self.crawled[v] else near[self.crawled[near]]

    def own_features(self, v: int) -> list[float]:
        """od, cc, cnf, tnf; zeros without a visible edge."""
        d = int(self.degree[v])
        if d == 0:
            return [0.0] * 4
        cc = 2.0 * self.triangles[v] / (d * (d - 1)) if d > 1 else 0.0
        c = int(self.crawled_near[v])
        return [1 / np.sqrt(d), cc, c / d, self.targets_near[v] / c if c else 0.0]

    def features(self, v: int) -> np.ndarray:
        """Own features, shares of the edges among neighbours with 2, 1, 0 targets, and the neighbours' means of own features."""
        near = self.visible(v)
        if not len(near):
            return np.zeros(11)
        ends = [0, 0, 0]
        target = self.graph.y[near] == 1
        for i, u in enumerate(near.tolist()):
            also = np.isin(near[i + 1 :], self.graph.near(u), assume_unique=True)
            if not self.crawled[u]:
                also &= self.crawled[near[i + 1 :]]
            for t in target[i + 1 :][also].tolist():
                ends[int(t) + int(target[i])] += 1
        total = max(sum(ends), 1)
        around = np.mean([self.own_features(u) for u in near.tolist()], axis=0)
        return np.array([*self.own_features(v), ends[2] / total, ends[1] / total, ends[0] / total, *around])
