"""Packing documents into training sequences by non-negative least squares on the histogram of piece lengths.

A document's ids are cut into whole windows and one rest. Combinations of up to four rest lengths that fill a window
exactly are enumerated; non-negative least squares finds how often to repeat each so that the repeats use up the
histogram; the counts are rounded down, and what remains is packed greedily, looking for exact fills first. All of this
works on counts by length, so its cost does not depend on the number of documents. Pieces then find their place by their
rank among the pieces of equal length, which needs no group in one task: ranks are counted within input partitions and
moved by the counts of the partitions before.

Null texts count as empty and have one piece, the end id. Repeated rows are packed as often as they come.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viewloom.llm.store import keep
from viewloom.llm.subwords import encode_words
from viewloom.llm.worker import Recent, held, lean, trimmed

COMBINATIONS = 40_000
#: Between a letter and other punctuation than an apostrophe the tokenizer always splits; so words with a comma need no entry of their own.
_JOINT = re.compile(rb"(?<=[a-z])(?=[!-&(-/:-@\[-`{-~])")
#: Distinct words whose ids a worker holds, about 200 bytes each.
CACHED = 800_000


def encode(texts: list[str | None], path: str, cached: int = CACHED) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text, without special tokens around it.

    For tokenizers that drop white space: texts are cut at ASCII white space and each distinct word is encoded once.
    """
    raw = [(t or "").encode() for t in texts]
    words = [(r if b"<|" in r else _JOINT.sub(b" ", r.lower())).split() for r in raw]
    known = held(("ids", path, cached), lambda: Recent(cached)).of(set().union(*words), lambda new: encode_words(new, path))
    return [b"".join(map(known.__getitem__, ws)) for ws in words]


def cut_pieces(docs: DataFrame, path: str, end_id: int, window: int, key: str = "doc_id", text: str = "text", cached: int = CACHED) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, and part and rank: the input partition, and the rank in it among pieces of this length."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranks = TaskContext.get().partitionId(), [0] * (window + 1)

        def pieces(keys: list, texts: list) -> pa.RecordBatch:
            out: list[tuple] = []
            for k, ids in zip(keys, encode(texts, path, cached), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, window):
                    length = min(window, n - start)
                    out.append((k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, part, ranks[length]))
                    ranks[length] += 1
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(len(names))], names)

        for batch in batches:
            keys, texts, size = [], [], 0
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(k)
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if size > 4 << 20:
                    yield pieces(keys, texts)
                    keys, texts, size = [], [], 0
            if keys:
                yield pieces(keys, texts)

    return lean(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(trimmed(run), ", ".join(f"{n} long" for n in names))


def combinations(h: np.ndarray, window: int, most: int = COMBINATIONS) -> np.ndarray:
    """Rows of up to four lengths (0: none), ascending, that sum to ``window`` and whose lengths all occur; the most frequent."""
    found: list[np.ndarray] = []
    size = np.arange(window + 1)
    a = size[1 : window // 2 + 1]
    pairs = a[(h[a] > 0) & (h[window - a] > 0)]
    found.append(np.stack([0 * pairs, 0 * pairs, pairs, window - pairs], 1))
    for x in np.flatnonzero(h[: window // 3 + 1]):
        if x:
            b = np.arange(x, (window - x) // 2 + 1)
            b = b[(h[b] > 0) & (h[window - x - b] > 0)]
            if len(b) > 64:
                b = b[np.argsort(-np.minimum(h[b], h[window - x - b]), kind="stable")[:64]]
            found.append(np.stack([0 * b, 0 * b + x, b, window - x - b], 1))
    # four: the best four pairs for each way to split the window in two sums
    best: dict[int, np.ndarray] = {}
    for s in range(2, window - 1):
        b = np.arange(1, s // 2 + 1)
        worth = np.minimum(h[b], h[s - b])
        top = b[np.argsort(-worth, kind="stable")[:4]]
        best[s] = np.stack([top, s - top], 1)[np.minimum(h[top], h[s - top]) > 0]
    for s in range(2, window // 2 + 1):
        p, q = best[s], best[window - s] if window - s in best else best[s][:0]
        if len(p) and len(q):
            found.append(np.concatenate([np.repeat(p, len(q), 0), np.tile(q, (len(p), 1))], 1))
    rows = np.unique(np.sort(np.concatenate(found), 1), axis=0)
    worth = np.where(rows > 0, h[rows], h.max() + 1).min(1)
    return rows[np.lexsort((*rows.T, -worth))[:most]]


def repeats(rows: np.ndarray, h: np.ndarray, steps: int = 300) -> np.ndarray:
    """x >= 0 that brings the lengths used by x repeats of each row near to ``h``: accelerated projected gradient on least squares."""
    if not len(rows):
        return np.zeros(0)
    used = lambda x: np.bincount(rows.ravel(), np.repeat(x, rows.shape[1]), len(h))
    back = lambda r: np.where(rows > 0, r[rows], 0).sum(1)
    v = np.ones(len(rows))
    for _ in range(20):
        u = used(v)
        u[0] = 0
        v = back(u)
        v /= np.linalg.norm(v)
    u = used(v)
    u[0] = 0
    rate = 1 / (np.linalg.norm(back(u)) * 1.05)
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        r = used(y) - h
        r[0] = 0
        new = np.maximum(0, y - rate * back(r))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = np.maximum(0, new + (t - 1) / t2 * (new - x))
        x, t = new, t2
    return x


def greedy(h: np.ndarray, window: int) -> list[tuple[list[int], int]]:
    """Pack the counts ``h`` (changed to zero): the longest first, filled up exactly if that can be found, else as far as it goes."""
    out: list[tuple[list[int], int]] = []

    def exact(gap: int, room: np.ndarray, depth: int) -> list[int] | None:
        if gap == 0:
            return []
        if room[gap] > 0:
            return [gap]
        if gap > 1:
            b = np.arange(1, gap // 2 + 1)
            worth = np.minimum(room[b], room[gap - b])
            if gap % 2 == 0:
                worth[-1] = room[gap // 2] // 2
            k = int(worth.argmax())
            if worth[k] > 0:
                return [int(b[k]), int(gap - b[k])]
        if depth:
            fits = np.flatnonzero(room[:gap])
            for x in fits[np.argsort(-room[fits], kind="stable")[: 12 if depth > 2 else 6]]:
                room[x] -= 1
                rest = exact(gap - int(x), room, depth - 1) if depth <= 2 or room[x] >= 0 else None
                room[x] += 1
                if rest is not None:
                    return [int(x), *rest]
        return None

    while True:
        left = np.flatnonzero(h)
        if not len(left):
            return out
        a = int(left[-1])
        h[a] -= 1
        rest = None
        taken, gap = [a], window - a
        for _ in range(window):
            rest = exact(gap, h, 2)
            if rest is not None:
                break
            fits = np.flatnonzero(h[: gap + 1])
            if not len(fits):
                break
            x = int(fits[-1])  # no exact fill: the longest that fits
            h[x] -= 1
            taken.append(x)
            gap -= x
        row = sorted(taken + (rest or []))
        for x in rest or []:
            h[x] -= 1
        kinds, each = np.unique(row, return_counts=True)
        more = int((h[kinds] // each).min())
        h[kinds] -= more * each
        out.append((row, 1 + more))


@dataclass
class Plan:
    """Where the pieces of each length go. A piece of ``length`` and rank r is in the interval with the largest begin <= r."""

    key: np.ndarray  # length << 40 | begin
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each piece."""
        i = np.searchsorted(self.key, (length << 40) | rank, side="right") - 1
        within = rank - (self.key[i] & ((1 << 40) - 1))
        return self.sequence[i] + within // self.copies[i], self.offset[i] + within % self.copies[i] * length


def make_plan(counts: dict[int, int], window: int) -> Plan:
    """A plan for ``counts`` pieces of each length up to ``window``."""
    h = np.zeros(window + 1, np.int64)
    for length, n in counts.items():
        h[length] = n
    patterns: list[tuple[list[int], int]] = [([window], int(h[window]))] if h[window] else []
    h[window] = 0
    rows = combinations(h, window)
    x = repeats(rows, h.astype(float))
    for i in np.argsort(-x, kind="stable"):
        n = int(x[i] + 0.5)
        if n < 1:
            break
        kinds, each = np.unique(rows[i][rows[i] > 0], return_counts=True)
        n = min(n, int((h[kinds] // each).min()))
        if n:
            h[kinds] -= n * each
            patterns.append((rows[i][rows[i] > 0].tolist(), n))
    patterns += greedy(h, window)
    used: dict[int, int] = {}
    slots: list[tuple[int, int, int, int]] = []
    sequence = 0
    for row, n in patterns:
        offset = 0
        for length in sorted(set(row), reverse=True):
            m = row.count(length)
            slots.append(((length << 40) | used.get(length, 0), m, sequence, offset))
            used[length] = used.get(length, 0) + m * n
            offset += m * length
        sequence += n
    slots.sort()
    return Plan(*(np.array([s[i] for s in slots], np.int64) for i in range(4)))


def pack(docs: DataFrame, path: str, end_id: int, window: int = 4096, key: str = "doc_id", text: str = "text", cached: int = CACHED) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = keep(cut_pieces(docs, path, end_id, window, key, text, cached), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.max("rank").alias("last")).select("part", "length", (F.col("last") + 1).alias("n"))
    plan = make_plan({r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}, window)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("moved"))
    ranked = pieces.join(moved, ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("moved")).alias("rank"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequence, offset = plan.place(batch.column(2).to_numpy(), batch.column(5).to_numpy())
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], pa.array(sequence), pa.array(offset)], names)

    return ranked.mapInArrow(run, ", ".join(f"{n} long" for n in names))
