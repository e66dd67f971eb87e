"""What Python workers hold, and how much they are given at once."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_held: dict = {}


def held(name: Hashable, make: Callable):
    """A worker's table of this name, such as words and their hashes. Workers live through many stages, so they hold one at a
    time, and give back what the one before took."""
    if name not in _held:
        _held.clear()
        give_back()
        _held[name] = make()
    return _held[name]


def give_back() -> None:
    """Return free memory to the system; workers would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """A function on a task's batches that gives memory back at the task's end."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return out


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Column names like ``wanted`` that are not among ``columns``, in whatever case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


class Recent:
    """Values by key, of keys asked for lately: at most about ``most``, in two generations."""

    def __init__(self, most: int) -> None:
        self.most, self.new, self.old = most, {}, {}

    def of(self, keys: set, make: Callable[[list], list]) -> dict:
        """A dict that has all ``keys``; values that aren't held are made, in one call."""
        if len(self.new) > self.most // 2:
            self.old, self.new = self.new, {}
        missing = keys.difference(self.new)
        if missing:
            old, new = self.old, self.new
            fresh = [k for k in missing if k not in old]
            new.update((k, old[k]) for k in missing if k in old)
            new.update(zip(fresh, make(fresh), strict=True))
        return self.new


def lean(df: DataFrame, size: str = "8m") -> DataFrame:
    """``df``, given to Python in batches of bounded size; a size that was set by hand stays."""
    conf = df.sparkSession.conf
    if conf.get(BATCH) == "67108864b":
        conf.set(BATCH, size)
    return df
