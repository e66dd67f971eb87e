"""Algorithms on small collections of differences, and modes."""

import pytest

from viewloom.errors import ComputationError, InitError
from viewloom.operators.algorithms import REGISTRY, make
from viewloom.operators.collection import DiffCollection
from viewloom.operators.timestamps import Timestamps
from viewloom.plans.modes import Adaptive, Predictor, run, should_split

START = [(6, 4), (4, 5), (4, 2), (5, 2), (2, 3), (5, 9), (3, 9), (9, 8)]
SCC1 = [(1, 2), (2, 3), (2, 5), (2, 6), (3, 4), (3, 7), (4, 3), (4, 8), (5, 1), (5, 6), (6, 7), (7, 6), (8, 7), (8, 4)]
SCC2 = [(0, 1), (0, 2), (1, 3), (3, 0), (2, 3), (2, 4), (3, 5), (4, 5), (5, 4), (4, 6), (6, 5), (6, 8), (6, 7), (6, 9), (8, 9), (9, 8), (7, 9)]
SCC3 = [(1, 0), (0, 2), (2, 1), (2, 4), (4, 3), (3, 2), (5, 6), (6, 7), (7, 8), (8, 5), (6, 8), (3, 5), (4, 6), (1, 11), (4, 11), (9, 10), (10, 9), (7, 9), (11, 9), (12, 13), (13, 14), (14, 12), (11, 12), (11, 14), (14, 15), (13, 15), (9, 15)]
IN1 = [(1, 2), (2, 5), (3, 4), (4, 3), (4, 8), (5, 1), (6, 7), (7, 6), (8, 4)]
IN2 = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 0), (4, 5), (4, 6), (5, 4), (6, 5), (8, 9), (9, 8)]
IN3 = [(0, 2), (1, 0), (2, 1), (2, 4), (3, 2), (4, 3), (5, 6), (6, 7), (6, 8), (7, 8), (8, 5), (9, 10), (10, 9), (12, 13), (13, 14), (14, 12)]


def collection(spark, views, lengths=None):
    """views: for each timestamp the added and the deleted edges."""
    rows = [(t, u, v, s) for t, (adds, dels) in enumerate(views) for s, part in ((1, adds), (-1, dels)) for u, v in part]
    return DiffCollection("c", Timestamps(tuple(lengths or (len(views),))), [], spark.createDataFrame(rows, "ts int, src long, dst long, diff long"))


def full(outcome, n):
    got = {i: [] for i in range(n)}
    for r in outcome.full.collect():
        got[r.ts].append((*tuple(r)[1:-1], r["diff"]))
    return [sorted(got[i]) for i in range(n)]


def plain(rows):
    return sorted((*r, 1) if isinstance(r, tuple) else (r, 1) for r in rows)


@pytest.mark.parametrize("mode", ["basic", "individual", "adaptive"])
def test_bfs(spark, mode):
    views = [(START, []), ([(2, 9)], [(4, 5)]), ([(9, 3), (6, 5)], [(5, 9), (2, 3)]), ([(4, 5), (2, 3)], [(2, 9), (9, 3)])]
    want = [{2: 2, 3: 3, 4: 1, 5: 2, 6: 0, 8: 4, 9: 3}, {2: 2, 3: 3, 4: 1, 6: 0, 8: 4, 9: 3}, {2: 2, 3: 4, 4: 1, 5: 1, 6: 0, 8: 4, 9: 3}, {2: 2, 3: 3, 4: 1, 5: 1, 6: 0, 8: 5, 9: 4}]
    assert full(run(make("bfs", {"root": 6}), collection(spark, views), mode), 4) == [plain(w.items()) for w in want]


def test_bfs_of_two_dimensions(spark):
    made = collection(spark, [(START, []), ([(6, 5)], [(5, 9)]), ([(2, 9)], [(4, 5)]), ([(9, 3)], [(2, 3)])], (2, 2))
    outcome = run(make("bfs", {"root": 6}), made)
    want = [{6: 0, 4: 1, 2: 2, 5: 2, 3: 3, 9: 3, 8: 4}, {6: 0, 4: 1, 5: 1, 2: 2, 3: 3, 9: 4, 8: 5}, {6: 0, 4: 1, 2: 2, 3: 3, 9: 3, 8: 4}, {6: 0, 4: 1, 5: 1, 2: 2, 9: 3, 3: 4, 8: 4}]
    assert full(outcome, 4) == [plain(w.items()) for w in want]
    diffs = {(r.ts, r.v, r.dist): r["diff"] for r in outcome.differences().collect()}
    assert {k[1:]: v for k, v in diffs.items() if k[0] == 1} == {(5, 2): -1, (9, 3): -1, (5, 1): 1, (9, 4): 1, (8, 5): 1, (8, 4): -1}
    assert {k[1:]: v for k, v in diffs.items() if k[0] == 2} == {(5, 2): -1}
    assert {k[1:]: v for k, v in diffs.items() if k[0] == 3} == {(8, 4): 1, (8, 5): -1, (3, 3): -1, (3, 4): 1, (9, 4): -1, (9, 3): 1, (5, 2): 1}


def test_wcc(spark):
    views = [(START, []), ([], [(5, 9), (2, 3)]), ([(3, 8)], [(4, 2), (4, 5)]), ([(5, 9), (2, 3)], [(3, 8)])]
    want = [dict.fromkeys([2, 3, 4, 5, 6, 8, 9], 2), {**dict.fromkeys([2, 4, 5, 6], 2), **dict.fromkeys([3, 8, 9], 3)}, {**dict.fromkeys([2, 5], 2), **dict.fromkeys([3, 8, 9], 3), **dict.fromkeys([4, 6], 4)}, {**dict.fromkeys([2, 3, 5, 8, 9], 2), **dict.fromkeys([4, 6], 4)}]
    assert full(run(make("wcc", {}), collection(spark, views), "compare_differential"), 4) == [plain(w.items()) for w in want]


def test_wcc_of_a_path_and_a_loop(spark):
    path = [(i, i + 1) for i in range(30)] + [(50, 50)]
    assert full(run(make("wcc", {}), collection(spark, [(path, [])])), 1) == [plain([*((i, 0) for i in range(31)), (50, 50)])]


def test_scc(spark):
    views = [(SCC2, []), (SCC1, SCC2), ([], [(6, 7), (7, 6)]), (SCC2, [e for e in SCC1 if e not in ((6, 7), (7, 6))])]
    outcome = run(make("scc", {}), collection(spark, views), "adaptive", splits=[2, 3])
    third = [e for e in IN1 if e not in ((6, 7), (7, 6))]
    assert full(outcome, 4) == [plain(IN2), plain(IN1), plain(third), plain(IN2)] and outcome.splits == [2, 3]
    diffs = [(r.ts, r.src, r.dst, r["diff"]) for r in outcome.differences().collect()]
    # a view at a split has its whole result
    assert sorted(d[1:] for d in diffs if d[0] == 2) == plain(third) and sorted(d[1:] for d in diffs if d[0] == 3) == plain(IN2)
    assert sorted(d[1:] for d in diffs if d[0] == 1) == sorted([(*e, 1) for e in IN1] + [(*e, -1) for e in IN2])


def test_scc_multiplicity_and_loops(spark):
    assert full(run(make("scc", {}), collection(spark, [(SCC3, [])])), 1) == [plain(IN3)]
    assert full(run(make("scc", {}), collection(spark, [([(1, 2), (1, 2), (2, 1), (3, 3), (3, 4)], [])])), 1) == [[(1, 2, 2), (2, 1, 1), (3, 3, 1)]]


def brute_pagerank(edges, n):
    out = {}
    for u, _ in edges:
        out[u] = out.get(u, 0) + 1
    rank = {v: 6_000_000 for e in edges for v in e}
    for _ in range(n):
        new = dict.fromkeys(rank, 1_000_000)
        for u, v in edges:
            new[v] += 5 * rank[u] // (6 * out[u])
        rank = new
    return rank


def test_pagerank(spark):
    one = {2: 6000000, 3: 6000000, 4: 6000000, 5: 3500000, 6: 1000000, 8: 6000000, 9: 8500000}
    made = collection(spark, [(START, [])])
    assert full(run(make("pr", {"iterations": 1}), made), 1) == [sorted(one.items())]
    assert full(run(make("pr", {"iterations": 10}), made), 1) == [sorted({2: 2498841, 3: 3082367, 4: 1833333, 5: 1763888, 6: 1000000, 8: 4586326, 9: 4303592}.items())]
    many = [*START, (4, 5), (8, 6)]
    assert full(run(make("pr", {"iterations": 5}), collection(spark, [(many, [])])), 1) == [sorted(brute_pagerank(many, 5).items())]
    assert full(run(make("pr", {"iterations": 0}), made), 1) == [sorted(brute_pagerank(START, 60).items())]


def test_sssp(spark):
    weight = lambda u, v: (u + v) % 7 + 1
    views = [(START, []), ([(6, 9), (8, 2)], [(4, 2)])]
    want, edges = [], set()
    for adds, dels in views:
        edges = (edges | set(adds)) - set(dels)
        best = {6: 0}
        for _ in range(20):
            for u, v in edges:
                if u in best:
                    best[v] = min(best.get(v, 10**9), best[u] + weight(u, v))
        want.append(plain(best.items()))
    assert full(run(make("sssp", {"root": 6, "weight_cap": 7}), collection(spark, views)), 2) == want


def test_mpsp(spark):
    views = [(START, []), ([(6, 9)], [(2, 3)])]
    got = full(run(make("mpsp", {"goals": [(6, 9), (6, 9), (4, 3), (8, 6), (7, 7)]}), collection(spark, views)), 2)
    assert got == [plain([(4, 3, 2), (6, 9, 3), (7, 7, 0)]), plain([(6, 9, 1), (7, 7, 0)])]


def test_parameters():
    for name, properties in (("bfs", {}), ("bfs", {"start": 1}), ("bfs", {"root": "x"}), ("wcc", {"root": 1}), ("mpsp", {"goals": 3})):
        with pytest.raises(InitError):
            make(name, properties)
    with pytest.raises(ComputationError):
        make("tc", {})
    assert sorted(REGISTRY) == ["bfs", "mpsp", "pr", "scc", "sssp", "wcc"]


def test_unsupported_mode(spark):
    with pytest.raises(ComputationError):
        run(make("wcc", {}), collection(spark, [(START, [])]), "timely")


def test_cost_model():
    scratch, on, a = Predictor(5, "lr"), Predictor(5, "lr"), Adaptive()
    for size in (100, 200):
        scratch.add(size, size / 100)
        on.add(size, size / 10)
    assert scratch.predict(300) == pytest.approx(3) and on.predict(30) == pytest.approx(3)
    assert should_split(100, 150, scratch, on, a) and should_split(300, 60, scratch, on, a) and not should_split(300, 10, scratch, on, a)
    assert Predictor(5, "avg").predict(3) is None
    one = Predictor(5, "lr")
    one.add(10, 1.0)
    assert one.predict(20) == pytest.approx(2)
