"""Timestamps of view collections: the views of one dimension, or the product of up to three dimensions."""

from __future__ import annotations

import itertools
from dataclasses import dataclass


@dataclass(frozen=True)
class Timestamps:
    """All timestamps in order, the last dimension fastest; a view's index is its place among them."""

    lengths: tuple[int, ...]

    @property
    def all(self) -> list[tuple[int, ...]]:
        return list(itertools.product(*map(range, self.lengths)))

    def __len__(self) -> int:
        out = 1
        for n in self.lengths:
            out *= n
        return out

    def index(self, ts: tuple[int, ...]) -> int:
        out = 0
        for n, i in zip(self.lengths, ts, strict=True):
            out = out * n + i
        return out

    def before(self, i: int) -> list[tuple[int, int]]:
        """(index, sign) of the views whose signed sum is what view i had before its own difference (inclusion and exclusion)."""
        ts = self.all[i]
        down = [d for d, x in enumerate(ts) if x]
        out = []
        for n in range(1, len(down) + 1):
            for chosen in itertools.combinations(down, n):
                near = tuple(x - (d in chosen) for d, x in enumerate(ts))
                out.append((self.index(near), 1 if n % 2 else -1))
        return out

    def after(self, i: int) -> list[tuple[int, int]]:
        """(index, sign) of the views whose difference view i enters: itself, and the views that have it in ``before``, negated."""
        ts = self.all[i]
        up = [d for d, x in enumerate(ts) if x + 1 < self.lengths[d]]
        out = [(i, 1)]
        for n in range(1, len(up) + 1):
            for chosen in itertools.combinations(up, n):
                out.append((self.index(tuple(x + (d in chosen) for d, x in enumerate(ts))), -1 if n % 2 else 1))
        return out

    def upto(self, i: int) -> list[int]:
        """The views whose differences add up to view i."""
        return [self.index(t) for t in itertools.product(*[range(x + 1) for x in self.all[i]])]

    def since(self, i: int) -> list[int]:
        """The views whose sums hold the difference of view i."""
        return [self.index(t) for t in itertools.product(*[range(x, n) for x, n in zip(self.all[i], self.lengths, strict=True)])]

    def text(self, i: int, separator: str = ",") -> str:
        return separator.join(map(str, self.all[i]))
