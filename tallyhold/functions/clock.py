"""Hybrid logical clock, and its form as columns."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class HybridClock:
    """Nanoseconds that follow the wall clock, never repeat and never go back, nor behind what was witnessed."""

    def __init__(self, start: int = 0, wall: Callable[[], int] = time.time_ns):
        self._last, self._wall, self._lock = start, wall, threading.Lock()

    def tick(self) -> int:
        with self._lock:
            self._last = max(self._wall(), self._last + 1)
            return self._last

    def witness(self, other: int) -> None:
        with self._lock:
            self._last = max(self._last, other)

    @property
    def current(self) -> int:
        return self._last


def ticked(events: DataFrame, wall: str, *, by: str = "machine", order: list[str] | None = None) -> DataFrame:
    """Column hlc: strictly ascending for each ``by``, at or after the wall clock of every event so far.

    greatest(wall, last + 1) unrolled: the n-th event's is n plus the most of wall - place so far.
    """
    w = W.partitionBy(by).orderBy(*(order or [wall]))
    rows = events.withColumn("_n", F.row_number().over(w).cast("long"))
    ahead: Column = F.max(F.col(wall) - F.col("_n")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("hlc", ahead + F.col("_n")).drop("_n")
