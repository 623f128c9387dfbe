"""Counters of a run, shown in the text format that scrapers read."""

from __future__ import annotations

import threading
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class Metrics:
    def __init__(self) -> None:
        self._lock, self.counters, self.seconds = threading.Lock(), {}, {}

    def add(self, name: str, n: int = 1) -> None:
        with self._lock:
            self.counters[name] = self.counters.get(name, 0) + n

    @contextmanager
    def timed(self, name: str):
        begun = time.perf_counter()
        try:
            yield
        finally:
            with self._lock:
                n, s = self.seconds.get(name, (0, 0.0))
                self.seconds[name] = (n + 1, s + time.perf_counter() - begun)

    def text(self) -> str:
        lines = []
        for k, v in sorted(self.counters.items()):
            lines += [f"# TYPE tessera_{k}_total counter", f"tessera_{k}_total {v}"]
        for k, (n, s) in sorted(self.seconds.items()):
            lines += [f"# TYPE tessera_{k}_seconds summary", f"tessera_{k}_seconds_count {n}", f"tessera_{k}_seconds_sum {s:.6f}"]
        return "\n".join(lines) + "\n"


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The table with a row count that is known once an action has run."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
