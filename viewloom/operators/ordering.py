"""The order of a collection's views: a short tour through their pairwise numbers of differing edges, from the empty view.

Works on a matrix of a row per view; nothing here depends on the number of edges. Ties go by the lower index, so the order
is the same on every run.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.operators.bits import BITS


def distances(masks: DataFrame, words: list[str], n: int) -> np.ndarray:
    """Edges that differ between each two of the n views and the empty view (row and column 0).

    Only the sizes of the views and of their intersections are needed, which are sums over edges; edges of equal masks are
    counted first.
    """
    counted = masks.groupBy(*words).agg(F.count("*").alias("n"))
    # one row for each two set bits of a distinct mask: pairs of views, not of edges
    bits = counted.withColumn("views", F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(F.getbit(F.element_at(F.array(*words), (i / BITS).cast("int") + 1), i % BITS) == 1, i)), lambda i: i.isNotNull()))
    pairs = bits.select("n", "views", F.explode("views").alias("i")).select("n", "i", F.explode("views").alias("j"))
    out = np.zeros((n, n), np.int64)
    for r in pairs.groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r["i"], r["j"]] = r["n"]
    return hamming(out)


def hamming(common: np.ndarray) -> np.ndarray:
    """From the sizes of intersections (sizes on the diagonal) to distances, with the empty view first."""
    size = np.concatenate([[0], np.diag(common)])
    both = np.zeros((len(size), len(size)), np.int64)
    both[1:, 1:] = common
    return size[:, None] + size[None, :] - 2 * both


def check_triangles(d: np.ndarray) -> None:
    """Distances of sets obey the triangle inequality; others would make the tour's bound worthless."""
    for k in range(len(d)):
        if (d > d[:, k, None] + d[None, k, :]).any():
            raise ValueError(f"distances through {k} are shorter than direct ones")


def spanning_tree(d: np.ndarray) -> list[tuple[int, int]]:
    """Lightest links that connect all views, by weight, then row, then column."""
    rows, cols = np.triu_indices(len(d), 1)
    group = list(range(len(d)))
    out = []
    for k in np.argsort(d[rows, cols], kind="stable"):
        u, v = int(rows[k]), int(cols[k])
        a, b = group[u], group[v]
        if a != b:
            out.append((u, v))
            group = [a if g == b else g for g in group]
    return out


def matching(d: np.ndarray, odd: list[int]) -> list[tuple[int, int]]:
    """Pairs of all vertices, the nearest two first."""
    left, out = set(odd), []
    for _, u, v in sorted((d[u, v], u, v) for u in odd for v in odd if u < v):
        if u in left and v in left:
            left -= {u, v}
            out.append((u, v))
    return out


def closed_walk(links: list[tuple[int, int]], first: int) -> list[int]:
    """A walk over every link once; at each vertex the lowest other end first, the begin last."""
    ends: dict[int, list[int]] = {}
    for u, v in links:
        ends.setdefault(u, []).append(v)
        ends.setdefault(v, []).append(u)
    for near in ends.values():
        near.sort(key=lambda x: (x == first, x))
    walk, stack = [], [first]
    while stack:
        near = ends.get(stack[-1])
        if near:
            v = near.pop(0)
            ends[v].remove(stack[-1])
            stack.append(v)
        else:
            walk.append(stack.pop())
    return walk[::-1]


def order(d: np.ndarray) -> list[int]:
    """The views (from 1) in the order of a tour that begins at the empty view."""
    check_triangles(d)
    if len(d) <= 2:
        return list(range(1, len(d)))
    tree = spanning_tree(d)
    degree = np.bincount(np.array(tree).ravel(), minlength=len(d))
    walk = closed_walk(tree + matching(d, [int(v) for v in np.flatnonzero(degree % 2)]), 0)
    return [v for v in dict.fromkeys(walk) if v]


def length(d: np.ndarray, views: list[int]) -> int:
    """The differences of a collection in this order: the first view's edges, then what changes."""
    return int(sum(d[a, b] for a, b in zip([0, *views], views)))
