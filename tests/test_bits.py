"""Sets of views as words, against plain sets."""

import random

import pytest
from pyspark.sql import functions as F

from viewloom.errors import InitError
from viewloom.operators.algorithms import Computation, ViewInput, make
from viewloom.operators.bits import Masked, chosen, expand, least_first, placed, word_names
from viewloom.operators.collection import DiffCollection, make_collection
from viewloom.operators.ordering import check_triangles
from viewloom.operators.timestamps import Timestamps
from viewloom.graph import Graph
from viewloom.lang.parser import parse_where
from viewloom.plans.modes import run
from viewloom.sources import shared


def marked(spark, sets, n):
    rows = [(i, *[sum(1 << (b - 63 * k) for b in s if b // 63 == k) for k in range(len(word_names(n)))]) for i, s in enumerate(sets)]
    return spark.createDataFrame(rows, ", ".join(["id long", *[f"{w} long" for w in word_names(n)]]))


def sets_of(df, n, views=None):
    out = {}
    for r in expand(df, word_names(n), views or range(n)).collect():
        out.setdefault(r.id, set()).add(r.ts)
    return out


def test_words(spark):
    rng, n = random.Random(1), 150
    sets = [set(rng.sample(range(n), rng.randint(1, n))) for _ in range(12)] + [{62}, {63}, {125, 126}, set(range(n))]
    df = marked(spark, sets, n)
    assert sets_of(df, n) == dict(enumerate(sets))
    for views in (range(60, 130), range(126, 150), [3, 149, 62, 63, 64]):
        part = df.select("id", *chosen(word_names(n), views))
        assert sets_of(part, len(views), views) == {i: s & set(views) for i, s in enumerate(sets) if s & set(views)}
    for first in (0, 5, 63, 100):
        moved = df.select("id", *placed(word_names(n), first, 300))
        assert sets_of(moved, 300) == {i: {b + first for b in s} for i, s in enumerate(sets)}


def test_least_first(spark):
    rng, n = random.Random(2), 70
    sets = [set(rng.sample(range(n), rng.randint(1, n))) for _ in range(40)]
    df = marked(spark, sets, n).withColumn("key", F.col("id") % 3).withColumn("value", F.col("id"))
    for wide in (False, True):
        got = sets_of(least_first(df, "key", "value", word_names(n), wide), n)
        want, seen = {}, [set(), set(), set()]
        for i, s in enumerate(sets):
            if s - seen[i % 3]:
                want[i] = s - seen[i % 3]
            seen[i % 3] |= s
        assert got == want


def test_collections_of_differences_as_words(spark):
    rng = random.Random(3)
    for lengths in ((100,), (3, 4)):
        stamps = Timestamps(lengths)
        rows = [(t, rng.randrange(4), rng.randrange(4), 1) for t in range(len(stamps)) for _ in range(3)]
        rows += [(len(stamps) - 1, u, v, -1) for _, u, v, _ in rows[:1]]
        made = DiffCollection("", stamps, [], spark.createDataFrame(rows, "ts int, src long, dst long, diff long"))
        views = range(1, len(stamps))
        want = sorted(map(tuple, made.view_edges(views).collect()))
        assert sorted(map(tuple, ViewInput(made.masks(views), views).all().select("ts", "src", "dst").collect())) == want
    wrong = DiffCollection("", Timestamps((2,)), [], spark.createDataFrame([(1, 0, 0, -1)], "ts int, src long, dst long, diff long"))
    with pytest.raises(Exception, match="deleted more often"):
        wrong.masks([0, 1]).collect()


def test_many_views_are_one_row_an_edge(spark):
    edges = spark.range(200).select("id", F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.col("id").alias("x"))
    graph = Graph(spark.range(201), edges)
    made = make_collection(graph, "", [[parse_where(f"x >= {i}") for i in range(130)]])
    data = ViewInput(made.masks(range(130)), range(130))
    assert data.rows().count() == 200 and data.masked().count() == 200
    before = set(shared._kept)
    done = run(make("bfs", {"root": 150}), made)
    assert len(set(shared._kept) - before) == 1  # only the result stays
    assert {r.ts: r["count"] for r in done.full.groupBy("ts").count().collect()} == dict.fromkeys(range(130), 51)
    assert done.differences().count() == 51  # nothing changes after the first view


def test_own_computations(spark):
    class Count(Computation):
        name, columns, parameters = "count", ("n", "label"), {"label": "string", "twice": "bool"}

        def run(self, data):
            return data.all().groupBy("ts").agg((F.count("*") * (2 if self.twice else 1)).alias("n")).select("ts", "n", F.lit(self.label).alias("label"), F.lit(1).cast("long").alias("diff"))

    made = DiffCollection("", Timestamps((3,)), [], spark.createDataFrame([(0, 1, 2, 1), (1, 2, 3, 2)], "ts int, src long, dst long, diff long"))
    for mode in ("basic", "individual", None):
        got = run(Count(label="edges", twice=True), made, mode)
        assert sorted((r.ts, r.n, r.label) for r in got.full.collect()) == [(0, 2, "edges"), (1, 6, "edges"), (2, 6, "edges")]
    assert "all: loaded" in got.report()
    with pytest.raises(InitError):
        Count(label=1, twice=True)


def test_masked_of_views_with_gaps(spark):
    df = spark.createDataFrame([(2, 5, 1), (7, 5, 1), (7, 6, 3)], "ts int, v long, diff long")
    assert sorted(map(tuple, Masked.of(df, [2, 7]).full().collect())) == [(2, 5, 1), (7, 5, 1), (7, 6, 3)]


def test_triangles():
    import numpy as np

    check_triangles(np.array([[0, 1, 2], [1, 0, 1], [2, 1, 0]]))
    with pytest.raises(ValueError, match="shorter"):
        check_triangles(np.array([[0, 1, 9], [1, 0, 1], [9, 1, 0]]))


def test_tables_are_deleted(spark):
    with shared.scratch() as saved:
        a, b = shared.keep(spark.range(3), "a"), shared.keep(spark.range(4), "b")
        saved.append(b)
    assert b.count() == 4 and a.kept_path not in shared._kept
    shared.forget(b, None, spark.range(1))
    assert b.kept_path not in shared._kept
