"""Collections: views, differences, order and timestamps."""

import numpy as np
import pytest

from viewloom.engine import Engine
from viewloom.errors import CollectionError
from viewloom.graph import Graph
from viewloom.operators.collection import DiffCollection, MaskCollection, make_collection
from viewloom.operators.ordering import distances, hamming, length, order
from viewloom.operators.results import accumulate, consolidate, differences
from viewloom.operators.timestamps import Timestamps
from viewloom.lang.parser import parse_where
from viewloom.sources.collections import generate_cube, load_cube, window_cube


@pytest.fixture(scope="module")
def engine(spark):
    vertices = [(i, "v1" if i < 4 else "v2") for i in range(10)]
    edges = [(0, 0, 5, "e1"), (1, 1, 6, "e1"), (2, 1, 7, "e1"), (3, 2, 8, "e1"), (4, 9, 0, "e2"), (5, 8, 2, "e2"), (6, 4, 3, "e2")]
    return Engine(spark, Graph(spark.createDataFrame(vertices, "id long, type string"), spark.createDataFrame(edges, "id long, src long, dst long, type string")))


def test_creation(engine):
    said = engine.execute("CREATE VIEW COLLECTION c WHERE [u.type='v1'],[u.type='v2'],[type='e1'] MANUALLY_ORDERED")
    assert "3 views" in said and "18 diffs" in said
    made = engine.collections["c"]
    full = lambda i: sorted(map(tuple, made.view(i).collect()))
    assert full(0) == full(2) == [(0, 5), (1, 6), (1, 7), (2, 8)] and full(1) == [(4, 3), (8, 2), (9, 0)]
    assert [(a, d) for a, d, _ in made.size_table()] == [(4, 0), (3, 4), (4, 3)]
    with pytest.raises(CollectionError):
        engine.execute("CREATE VIEW COLLECTION c WHERE [type='e1']")
    assert "c: 3 views" in engine.execute("SHOW COLLECTIONS") and "total: 4" in engine.execute("SHOW DATA FOR COLLECTION 'c'")
    engine.execute("DELETE CUBES")
    with pytest.raises(CollectionError):
        engine.execute("SHOW DATA FOR COLLECTION 'c'")


def test_bits_to_differences(spark):
    bits = [1, 1, 1, 1, 1, 1, 1, 0, 1, 1]
    edges = spark.createDataFrame([(0, 3, 4, sum(b << i for i, b in enumerate(bits)))], "edge_id long, src long, dst long, w0 long")
    made = MaskCollection("", Timestamps((10,)), [], edges, ["w0"])
    assert sorted((r.ts, r["diff"]) for r in made.diffs().collect()) == [(0, 1), (7, -1), (8, 1)]


def test_many_views(spark):
    edges = spark.createDataFrame([(i, i, i + 1, i) for i in range(140)], "id long, src long, dst long, k long")
    graph = Graph(spark.createDataFrame([(i,) for i in range(141)], "id long"), edges)
    made = make_collection(graph, "", [[parse_where(f"k = {i}") for i in range(130)]])
    assert made.words == ["w0", "w1", "w2"]
    assert sorted((r.ts, r.src) for r in made.view_edges().collect()) == [(i, i) for i in range(130)]
    assert made.diffs().count() == 259


def test_order():
    rows = [[0, 1, 0, 0, 0]] * 10 + [[0, 1, 1, 1, 0]] * 40 + [[0, 1, 1, 1, 1]] * 10 + [[0, 0, 1, 0, 1]] * 140
    m = np.array(rows)
    d = hamming((m[:, 1:, None] & m[:, None, 1:]).sum(0))
    assert d.tolist() == [[0, 60, 190, 50, 150], [60, 0, 150, 10, 190], [190, 150, 0, 140, 40], [50, 10, 140, 0, 180], [150, 190, 40, 180, 0]]
    assert length(d, [1, 2, 3, 4]) == 530 and length(d, order(d)) == 250


def test_order_of_random_views(spark):
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 9, 17):
        bits = rng.random((60, n)) < 0.4
        masks = spark.createDataFrame([(int(sum(int(b) << i for i, b in enumerate(r))),) for r in bits], "w0 long")
        d = distances(masks, ["w0"], n)
        padded = np.column_stack([np.zeros(60, bool), bits])
        assert (d == (padded[:, :, None] != padded[:, None, :]).sum(0)).all()
        assert sorted(order(d)) == list(range(1, n + 1))


def test_computed_order_keeps_views(engine):
    texts = ["type = 'e1'", "type = 'e2'", "u.type = 'v1'", "type = 'e2' and u.type = 'v2'"]
    a = engine.create_collection("manual", texts)
    b = engine.create_collection("best", texts, manual=False)
    assert sorted(b.texts) == sorted(a.texts) and sum(x + y for x, y, _ in b.size_table()) <= sum(x + y for x, y, _ in a.size_table())
    for i, text in enumerate(b.texts):
        assert sorted(map(tuple, b.view(i).collect())) == sorted(map(tuple, a.view(a.texts.index(text)).collect()))


def test_timestamps():
    assert [Timestamps((5,)).before(i) for i in range(5)] == [[], [(0, 1)], [(1, 1)], [(2, 1)], [(3, 1)]]
    grid = Timestamps((3, 3))
    assert [sorted(grid.before(i)) for i in range(9)] == [[], [(0, 1)], [(1, 1)], [(0, 1)], [(0, -1), (1, 1), (3, 1)], [(1, -1), (2, 1), (4, 1)], [(3, 1)], [(3, -1), (4, 1), (6, 1)], [(4, -1), (5, 1), (7, 1)]]
    cube = Timestamps((2, 3, 2))
    for i in range(len(cube)):
        for j, s in cube.after(i):
            assert j == i or (i, -s) in cube.before(j)


def test_differences_and_back(spark):
    stamps = Timestamps((2, 3))
    full = spark.createDataFrame([(t, v, 1 + (v + t) % 2) for t in range(6) for v in range(5) if (v * t) % 3 != 1], "ts int, v long, diff long")
    back = accumulate(differences(full, stamps), stamps)
    assert consolidate(back.unionByName(full.withColumn("diff", -full["diff"]))).count() == 0


def test_load_cube(spark, tmp_path):
    for j, text in enumerate(["1,2,+1\n2,3,1\n", "2,3,-1\n5,5,0\n4,1,+1\n"]):
        (tmp_path / f"b_0_{j}.txt").write_text(text)
    made = load_cube(spark, "c", (2,), str(tmp_path), "b_", with_full=True)
    assert sorted(map(tuple, made.view(1).collect())) == [(1, 2), (4, 1)] and made.size_table() == [(2, 0, 2), (1, 1, 2)]
    (tmp_path / "b_0_1.txt").write_text("1,x,+1\n")
    with pytest.raises(Exception, match="CollectionError"):
        load_cube(spark, "c", (2,), str(tmp_path), "b_")


def test_random_collections(spark):
    edges = spark.range(300).selectExpr("id AS src", "id + 1 AS dst")
    for made, want in ((generate_cube("g", edges, 100, 20, 15, 4), [(100, 0, 100)] + [(20, 15, 100 + 5 * (i + 1)) for i in range(4)]), (window_cube("w", edges, 100, 10, 40, 2, 3), [(100, 0, 100), (5, 5, 100), (20, 20, 100), (5, 5, 100), (20, 20, 100), (5, 5, 100)])):
        assert made.size_table() == want
    with pytest.raises(CollectionError):
        generate_cube("g", edges, 290, 20, 0, 4)
    with pytest.raises(CollectionError):
        generate_cube("g", edges, 10, 1, 20, 2)


def test_more_deletions_than_additions_are_an_error(spark):
    changes = spark.createDataFrame([(0, 1, 2, 1), (1, 1, 2, -2)], "ts int, src long, dst long, diff long")
    with pytest.raises(Exception, match="deleted more often"):
        DiffCollection("", Timestamps((2,)), [], changes).view_edges().collect()
