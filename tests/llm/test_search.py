"""Search against scoring all documents."""

import math
import random
from collections import Counter

import numpy as np

from viewloom.llm.search import Batch, Settings, Shard, pack_queries, top_k, words


def brute(rows, asked, s):
    docs = [(words(t or ""), i) for i, t in rows]
    n, mean = len(docs), max(1, sum(len(w) for w, _ in docs)) / len(docs)
    df = Counter(t for w, _ in docs for t in set(w))
    idf = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    out = []
    for i, t in asked:
        tf = Counter(words(t or ""))
        terms = sorted(tf)
        scored = []
        for found, d in docs:
            c = Counter(found)
            score = sum(idf[t] * c[t] * (s.k1 + 1) / (c[t] + s.k1 * (1 - s.b + s.b * len(found) / mean)) for t in terms if c[t])
            if score and d is not None:
                scored.append((-round(score, 6), d))
        out += [(i, r + 1, d, -v) for r, (v, d) in enumerate(sorted(scored)[: s.k])]
    return sorted(out, key=str)


def test_against_all(spark):
    rng = random.Random(3)
    bag = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(4000)]
    rows = [(i, " ".join(rng.choice(bag) for _ in range(rng.randint(1, 60)))) for i in range(300)]
    rows += [(300, None), (301, ""), (None, "w1 w2"), (302, rows[0][1]), (302, rows[0][1]), (303, "W1 " * 5000), (304, "\u00e9\u00a0x w3")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, rank int")
    for s in (Settings(), Settings(k=3, batch=2, shards=1)):
        asked = [r for r in rows if r[0] is not None and r[0] % 50 == 0 or r[0] in (301, 302, 304)]
        got = sorted(map(tuple, top_k(docs, docs.filter("doc_id % 50 = 0 OR doc_id IN (301, 302, 304)"), s).collect()), key=str)
        assert [g[:3] for g in got] == [g[:3] for g in brute(rows, asked, s)]
        assert [(a, b) for a, b in zip(got, brute(rows, asked, s), strict=True) if not abs(a[3] - b[3]) < 2e-6] == []


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert top_k(none, none).collect() == []


def test_pruning_is_exact():
    rng = np.random.default_rng(5)
    skipped, s = 0, Settings(k=5, block=16)
    for _ in range(60):
        n, lists = int(rng.integers(1, 900)), 6
        freqs = rng.integers(1, 30, (lists, n)) * (rng.random((lists, n)) < rng.random((lists, 1)) ** 2)
        freqs[:, : n // 4] *= 20
        lengths, ids, terms = rng.integers(1, 500, n).astype(float), rng.permutation(n), np.arange(lists) * 7 + 3
        idf = np.round(rng.random(lists) * 3 + 0.1, 3)
        batch = Batch([pack_queries([8], [terms[::-1].tolist()], [idf[::-1].tolist()])], s.k)
        some = np.flatnonzero(freqs.any(1))
        if not len(some):
            continue
        where, docs = np.nonzero(freqs[some])
        made = Shard(batch, terms[some], np.bincount(where, minlength=len(some)), docs, freqs[some][where, docs].astype(float), lengths, 100.0, s)
        skipped += made.blocks - made.search(batch, 0, ids, np.zeros(n, bool))
        parts = np.where(freqs > 0, idf[:, None] * freqs * (s.k1 + 1) / (freqs + s.k1 * (1 - s.b + s.b * lengths / 100.0)), 0)
        want = sorted((-round(t, 6), int(i)) for t, i in zip(parts.sum(0).tolist(), ids.tolist(), strict=True) if t > 0)[: s.k]
        got = [(-float(v), int(i)) for v, i in zip(batch.scores[0], batch.ids[0], strict=True) if np.isfinite(v)]
        assert [g[1] for g in got] == [w[1] for w in want] and np.allclose([g[0] for g in got], [w[0] for w in want], atol=2e-6)
    assert skipped > 0


def test_queries_go_through_a_shard_together():
    """Lists in the matrix and outside, several shards, documents of null ids, and floors of earlier shards."""
    rng = np.random.default_rng(6)
    n, lists, s = 500, 300, Settings(k=4, block=16)
    idf = np.round(rng.random(lists) * 5 + 0.1, 3)
    wants = [np.sort(rng.choice(lists, int(rng.integers(1, 60)), replace=False)) for _ in range(40)]
    batch = Batch([pack_queries(list(range(40)), [w.tolist() for w in wants], [idf[w].tolist() for w in wants])], s.k)
    lengths, ids = rng.integers(1, 500, (3, n)).astype(float), rng.permutation(3 * n).reshape(3, n)
    nulls = rng.random((3, n)) < 0.1
    found = [[] for _ in wants]
    for k in range(3):
        freqs = rng.integers(1, 9, (lists, n)) * (rng.random((lists, n)) < rng.random((lists, 1)) ** 6)
        parts = np.where(freqs > 0, idf[:, None] * freqs * (s.k1 + 1) / (freqs + s.k1 * (1 - s.b + s.b * lengths[k] / 250.0)), 0)
        for q, w in enumerate(wants):
            found[q] += [(-round(t, 6), int(i)) for t, i, null in zip(parts[w].sum(0).tolist(), ids[k].tolist(), nulls[k], strict=True) if t > 0 and not null]
        some = np.flatnonzero(freqs.any(1))
        where, docs = np.nonzero(freqs[some])
        made = Shard(batch, some, np.bincount(where, minlength=len(some)), docs, freqs[some][where, docs].astype(float), lengths[k], 250.0, s)
        assert 0 < len(made.tops) < len(some)
        made.AT_ONCE = 1000
        made.search(batch, batch.order, ids[k], nulls[k])
    for q, scored in enumerate(found):
        want = sorted(scored)[: s.k]
        got = [(-float(v), int(i)) for v, i in zip(batch.scores[q], batch.ids[q], strict=True) if np.isfinite(v)]
        assert [g[1] for g in got] == [w[1] for w in want] and np.allclose([g[0] for g in got], [w[0] for w in want], atol=2e-6)
