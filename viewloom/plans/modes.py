"""How a computation runs over a collection. Modes differ in time, not in answers.

* all views together (basic, 1_stage_differential, 2_stage_differential): each superstep is one job for all views, and what
  views share is computed once, as rows carry the sets of their views;
* one after the other (individual, basic_individual);
* adaptive: views in runs, a new run where a view is expected to cost more together with those before than by itself;
* compare_differential: together and one after the other, and the results are compared.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame

from viewloom.errors import ComputationError
from viewloom.operators.algorithms import Computation, ViewInput
from viewloom.operators.bits import Masked
from viewloom.operators.collection import Collection
from viewloom.operators.results import mismatches
from viewloom.sources.shared import keep, scratch

TOGETHER = ("basic", "1_stage_differential", "2_stage_differential")
ONE_BY_ONE = ("individual", "basic_individual")


@dataclass
class Run:
    """Views that were computed together, and the seconds until their edges were loaded, the result stable, and it was written."""

    first: int
    last: int
    loaded: float
    stable: float
    total: float


@dataclass
class Outcome:
    """result: of all views; splits: views that began anew; runs: by views computed together."""

    result: Masked
    collection: Collection
    splits: list[int] = field(default_factory=list)
    runs: list[Run] = field(default_factory=list)

    @property
    def full(self) -> DataFrame:
        """ts, columns, diff of each view's whole result."""
        return self.result.full()

    def differences(self) -> DataFrame:
        """ts, columns, diff: what changes from view to view; a view of ``splits`` has its whole result."""
        return self.result.differences(self.collection.timestamps, self.splits)

    def report(self) -> str:
        """Seconds by run: edges loaded, result stable, total."""
        lines = [f"views {r.first}-{r.last}: loaded {r.loaded:.2f}, stable {r.stable:.2f}, total {r.total:.2f}" for r in self.runs]
        return "\n".join([*lines, f"all: loaded {sum(r.loaded for r in self.runs):.2f}, stable {sum(r.stable for r in self.runs):.2f}, total {sum(r.total for r in self.runs):.2f}"])


@dataclass(frozen=True)
class Adaptive:
    """upto: views decided at once; comp_x, diff_x: how much dearer a run must be; limit: measurements used; algo: lr or avg."""

    upto: int = 10
    comp_x: float = 1.3
    diff_x: float = 1.0
    limit: int = 10
    algo: str = "lr"


class Predictor:
    """Time by size from the last measurements: a line by least squares, or the mean ratio where that is not finite."""

    def __init__(self, limit: int, algo: str) -> None:
        self.limit, self.algo, self.seen = limit, algo, []

    def add(self, size: int, seconds: float) -> None:
        if size:
            self.seen = [*self.seen, (size, seconds)][-max(1, self.limit) :]

    def predict(self, size: int) -> float | None:
        if not self.seen:
            return None
        n = len(self.seen)
        x, y = [s for s, _ in self.seen], [t for _, t in self.seen]
        spread = n * sum(a * a for a in x) - sum(x) ** 2
        if self.algo == "lr" and spread:
            slope = (n * sum(a * b for a, b in self.seen) - sum(x) * sum(y)) / spread
            return max(0.0, (sum(y) - slope * sum(x)) / n + slope * size)
        return sum(t / s for s, t in self.seen) / n * size


def should_split(size: int, changes: int, scratch: Predictor, run: Predictor, a: Adaptive) -> bool:
    """Whether a view is cheaper anew: it changes more than it holds, or its run is predicted to be dearer."""
    if changes > a.diff_x * size:
        return True
    fresh, on = scratch.predict(size), run.predict(changes)
    return fresh is not None and on is not None and a.comp_x * fresh < on


def _together(computation: Computation, collection: Collection, views: Sequence[int], runs: list[Run]) -> Masked:
    """The result of some views; all other tables that were written for it are deleted."""
    began = time.time()
    views = list(views)
    with scratch() as saved:
        data = ViewInput(collection.masks(views), views)
        data.rows()
        loaded = time.time() - began
        got = computation.run(data)
        found = got if isinstance(got, Masked) else Masked.of(got, views)
        stable = time.time() - began - loaded
        rows = keep(found.rows, "result")
        saved.append(rows)
    runs.append(Run(views[0], views[-1], loaded, stable, time.time() - began))
    return Masked(rows, views, found.adds)


def _outcome(parts: list[Masked], collection: Collection, runs: list[Run], splits: Sequence[int] = ()) -> Outcome:
    n = len(collection.timestamps)
    placed = [p.among(n) for p in parts] if len(parts) > 1 else parts
    rows = reduce(DataFrame.unionByName, [p.rows for p in placed])
    return Outcome(Masked(rows, range(n), any(p.adds for p in parts)), collection, list(splits), runs)


def _adaptive(computation: Computation, collection: Collection, a: Adaptive, fixed: Sequence[int] | None) -> Outcome:
    """Runs of up to ``upto`` views. A run's time is shared out by what it took: its first view's edges, and later views' changes."""
    n = len(collection.timestamps)
    runs: list[Run] = []
    if fixed is not None:
        splits = sorted({s for s in fixed if 0 < s < n})
        bounds = [0, *splits, n]
        return _outcome([_together(computation, collection, range(i, j), runs) for i, j in zip(bounds, bounds[1:])], collection, runs, splits)
    sizes = collection.size_table()
    changed = [adds + dels for adds, dels, _ in sizes]
    fresh, on = Predictor(a.limit, a.algo), Predictor(a.limit, a.algo)
    splits, parts, at = [], [], 0
    while at < n:
        end = min(n, at + a.upto)
        wanted = [i for i in range(max(1, at), end) if should_split(sizes[i][2], changed[i], fresh, on, a)]
        if at in wanted:
            splits.append(at)
        stop = next((i for i in wanted if i > at), end)
        parts.append(_together(computation, collection, range(at, stop), runs))
        later = sum(changed[at + 1 : stop])
        each = runs[-1].total / max(1, sizes[at][2] + later)
        fresh.add(sizes[at][2], each * sizes[at][2])
        on.add(later, each * later)
        at = stop
    return _outcome(parts, collection, runs, splits)


def run(computation: Computation, collection: Collection, mode: str | None = "basic", adaptive: Adaptive | None = None, splits: Sequence[int] | None = None) -> Outcome:
    """Run a computation over all views of a collection. No mode: adaptive."""
    views = list(range(len(collection.timestamps)))
    runs: list[Run] = []
    if mode == "timely":
        raise ComputationError("timely is not supported")
    if not views:
        raise ComputationError(f"Collection '{collection.name}' has no views")
    if mode in (None, "adaptive"):
        return _adaptive(computation, collection, adaptive or Adaptive(), splits)
    if mode in TOGETHER:
        return _outcome([_together(computation, collection, views, runs)], collection, runs)
    if mode in ONE_BY_ONE:
        return _outcome([_together(computation, collection, [i], runs) for i in views], collection, runs)
    if mode == "compare_differential":
        a, b = run(computation, collection, "basic"), run(computation, collection, "individual")
        wrong = mismatches(a.full, b.full).limit(3).collect()
        if wrong:
            raise ComputationError(f"Results do not match: {[tuple(r) for r in wrong]}")
        return a
    raise ComputationError(f"Unknown mode '{mode}'")
