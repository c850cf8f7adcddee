"""When a model learns anew, and from what."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from gleaner.crawl.state import Crawl, Csr


@dataclass
class Schedule:
    """Due once `train_from` nodes are crawled, and then whenever their number has grown by the factor `exponent` since the model last learned."""

    train_from: int = 10
    exponent: float = 1.15
    last: int = 0

    def due(self, n: int) -> bool:
        return n >= self.train_from and n >= self.last * self.exponent

    def learned(self, n: int) -> None:
        self.last = n


class Online:
    """Inputs of the seeds as they were right after they were crawled; a seed without a label counts as no target.

    The newest `window` are taken, half as many more until both classes are there; nothing if they aren't before that exceeds what was seen.
    """

    def __init__(self, state: Crawl, rng: np.random.Generator, window: int = 300, **_):
        self.state, self.window, self.labels, self.inputs = state, window, [], {}

    def saw(self, seed: int, models: list) -> None:
        self.labels.append(int(self.state.graph.y[seed] == 1))
        for m in models:
            if m.learns:
                self.inputs.setdefault(id(m), []).append(m.inputs(seed))

    def samples(self, model) -> tuple[list, list]:
        if not model.learns:
            return [], []
        size = min(self.window, len(self.labels))
        while len(set(self.labels[-size:])) < 2:
            size = int(size * 1.5) if size > 1 else size + 1
            if size > len(self.labels):
                return [], []
        return self.inputs[id(model)][-size:], self.labels[-size:]


class Boosting:
    """Random re-crawls of the crawled part of the graph: inputs are taken from the end of each backwards, for as many targets as others.

    A re-crawl gives `share` of its steps, half of them targets, with both numbers rounded up or down at random so that they hold on average; fewer if it has
    fewer of a kind, and never its first node. It sees no label of a node that it hasn't crawled.
    """

    def __init__(self, state: Crawl, rng: np.random.Generator, samples: int = 300, iterations: int = 20, share: float = 0.2, **_):
        self.state, self.rng, self.wanted, self.iterations, self.share = state, rng, samples, iterations, share

    def saw(self, seed: int, models: list) -> None:
        pass

    def samples(self, model) -> tuple[list, list]:
        crawled = np.array(self.state.order)
        y = self.state.graph.y[crawled]
        if not model.learns or not ((y == 1).any() and (y == 0).any()):
            return [], []
        full = self.state.graph
        place = {int(v): i for i, v in enumerate(np.sort(crawled))}
        src = [(place[v], place[int(u)]) for v in place for u in full.near(v) if int(u) in place and v < u]
        if not src:
            return [], []
        a, b = (np.array(x) for x in zip(*src))
        names = np.sort(crawled)
        inner = Csr.build(a, b, {i: int(full.y[v]) for i, v in enumerate(names.tolist())})
        xs, ys = [], []
        for _ in range(self.iterations):
            x, t = self._replay(model, inner)
            xs += x
            ys += t
            if len(xs) >= self.wanted:
                break
        return xs[: self.wanted], ys[: self.wanted]

    def _round(self, x: float) -> int:
        return int(x) + int(self.rng.random() < x - int(x))

    def _order(self, graph: Csr) -> list[int]:
        """A random crawl of all of the graph's nodes that the first one reaches."""
        state = Crawl(graph)
        pool, order = [int(self.rng.integers(len(graph.ids)))], []
        state.observe(pool[0])
        while pool:
            order.append(pool.pop(int(self.rng.integers(len(pool)))))
            pool += state.crawl(order[-1])
        return order

    def _replay(self, model, graph: Csr) -> tuple[list, list]:
        order = self._order(graph)
        size = self.share * len(order)
        left = {1: self._round(size / 2)}
        left[0] = self._round(size - left[1])
        picked: dict[int, int] = {}
        for v in reversed(order[1:]):
            y = int(graph.y[v])
            if left.get(y, 0) > 0:
                picked[v] = y
                left[y] -= 1
        state = Crawl(graph)
        state.observe(order[0])
        x, t = [], []
        for v in order:
            if v in picked:
                x.append(model.inputs(v, state))
                t.append(picked[v])
            state.crawl(v)
        return x, t
