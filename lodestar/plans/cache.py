"""A driver-side cache of bounded search results: the same parameters and a query vector close enough give the same rows."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Hashable, Sequence

import numpy as np


class SemanticCache:
    def __init__(self, entries: int = 512, threshold: float = 0.97):
        self.entries, self.threshold = entries, threshold
        self._held: OrderedDict[int, tuple[Hashable, np.ndarray, list]] = OrderedDict()
        self._next = 0
        self._version: object = None

    def at_version(self, version: object) -> None:
        """Forget everything once the corpus has another version."""
        if version != self._version:
            self._held.clear()
            self._version = version

    def get(self, signature: Hashable, vector: Sequence[float]) -> list | None:
        q = np.asarray(vector, dtype=float)
        for own, v, rows in self._held.values():
            if own == signature and len(v) == len(q):
                scale = np.sqrt((v * v).sum() * (q * q).sum())
                if scale > 0 and (v * q).sum() / scale >= self.threshold:
                    return rows
        return None

    def put(self, signature: Hashable, vector: Sequence[float], rows: list) -> None:
        if not rows or self.entries <= 0:
            return
        self._held[self._next] = (signature, np.asarray(vector, dtype=float), rows)
        self._next += 1
        while len(self._held) > self.entries:
            self._held.popitem(last=False)

    def through(self, signature: Hashable, vector: Sequence[float], search: Callable[[], list]) -> list:
        found = self.get(signature, vector)
        if found is None:
            found = search()
            self.put(signature, vector, found)
        return found
