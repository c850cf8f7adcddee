"""How often methods of a crawl's parts are called, and how long they take."""

from __future__ import annotations

import time
from collections import defaultdict


class Counters:
    """calls and seconds by name; watch() makes an object report on some of its methods, with what it returns unchanged."""

    def __init__(self) -> None:
        self.calls: dict[str, int] = defaultdict(int)
        self.seconds: dict[str, float] = defaultdict(float)

    def watch(self, thing, *methods: str):
        for name in methods:
            setattr(thing, name, self._timed(getattr(thing, name), f"{type(thing).__name__}.{name}"))
        return thing

    def _timed(self, method, name: str):
        def call(*args, **kwargs):
            began = time.perf_counter()
            try:
                return method(*args, **kwargs)
            finally:
                self.calls[name] += 1
                self.seconds[name] += time.perf_counter() - began

        return call

    def rows(self) -> list[tuple[str, int, float]]:
        return sorted((n, c, self.seconds[n]) for n, c in self.calls.items())
