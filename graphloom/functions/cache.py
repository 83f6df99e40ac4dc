"""Results that are kept for a while."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame


class ResultCache:
    """Results by query, repository and commit, kept by Spark on the executors' disks: a lost executor's part is
    computed again. At most ``most`` results, each for ``ttl`` seconds; what has expired goes first, then the oldest."""

    def __init__(self, most: int = 100, ttl: float = 3600, clock: Callable[[], float] = time.monotonic) -> None:
        self.most, self.ttl, self.clock = most, ttl, clock
        self.hits = self.misses = 0
        self._kept: dict[tuple[str, str, str], tuple[DataFrame, float]] = {}

    def get(self, query: str, repo: str, commit: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (query, repo, commit)
        if key in self._kept and self.clock() - self._kept[key][1] < self.ttl:
            self.hits += 1
            return self._kept[key][0]
        self.misses += 1
        self._drop(key)
        while len(self._kept) >= max(1, self.most):
            self._drop(min(self._kept, key=lambda k: self._kept[k][1]))  # the oldest are those that expire first
        df = build().persist(StorageLevel.DISK_ONLY)
        self._kept[key] = (df, self.clock())
        return df

    def invalidate(self, repo: str) -> None:
        """Drops a repository's results, as after a new index."""
        for key in [k for k in self._kept if k[1] == repo]:
            self._drop(key)

    def _drop(self, key: tuple[str, str, str]) -> None:
        if old := self._kept.pop(key, None):
            old[0].unpersist()
