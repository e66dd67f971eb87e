"""Loading, saving, scripts and streams."""

import pytest

from viewloom.engine import Engine
from viewloom.errors import CollectionError, ComputationError, EngineError, LoadGraphError, SerdeError
from viewloom.streaming.growing import GrowingCollection

VERTICES = "# people\n:id,city,age:int,ok:bool\na,x,3,true\nb,,-4,false\nc,\"p,q\",,\nragged\nd,z,+7,true\n"
EDGES = "from:start_id,to:end_id,w:int\na,b,1\nb,c,2\nz,a,9\nc,d,\nd,a,5\n,a,3\n"


@pytest.fixture
def files(tmp_path):
    (tmp_path / "v.txt").write_text(VERTICES)
    (tmp_path / "e.txt").write_text(EDGES)
    return tmp_path


def load(spark, files, extra=""):
    engine = Engine(spark)
    said = engine.execute(f"LOAD GRAPH WITH VERTICES FROM '{files}/v.txt' AND EDGES FROM '{files}/e.txt' COMMENT '#' {extra};")
    return engine, said


def test_load(spark, files):
    engine, said = load(spark, files, f"SAVE MAPPINGS TO '{files}/maps'")
    assert said == "4 vertices and 4 edges loaded"
    assert sorted(map(tuple, engine.graph.vertices.select("id", "ext_id", "city", "age", "ok").collect())) == [(0, "a", "x", 3, True), (1, "b", None, -4, False), (2, "c", "p,q", None, None), (3, "d", "z", 7, True)]
    assert sorted(map(tuple, engine.graph.edges.select("id", "src", "dst", "w").collect())) == [(0, 0, 1, 1), (1, 1, 2, 2), (2, 2, 3, None), (3, 3, 0, 5)]
    assert sorted(r.value for r in spark.read.text(f"{files}/maps/vertex_mappings.txt").collect()) == ["a,0", "b,1", "c,2", "d,3"]
    shuffled, _ = load(spark, files, "RANDOMIZE")
    assert sorted(r.id for r in shuffled.graph.edges.collect()) == [0, 1, 2, 3]


def test_load_without_vertices(spark, tmp_path):
    (tmp_path / "e").write_text("5|7\n7|9\n|5\n3|\n5|1\n")
    engine = Engine(spark)
    assert engine.execute(f"LOAD GRAPH WITH EDGES FROM '{tmp_path}/e' SEPARATOR '|' HAS_HEADERS false") == "5 vertices and 3 edges loaded"
    assert [r.ext_id for r in engine.graph.vertices.orderBy("id").collect()] == ["5", "7", "9", "3", "1"]
    engine.execute(f"SAVE GRAPH TO '{tmp_path}/out'")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out/edges.txt").collect()) == ["0,1", "0,4", "1,2"]


@pytest.mark.parametrize(("vertices", "edges", "words"), [(":id,a:int\nx,1x\n", "s:start_id,d:end_id\nx,x\n", "parse property"), (":id\nx\nx\n", "s:start_id,d:end_id\nx,x\n", "twice"), (":id,a:uint\nx,1\n", "s:start_id,d:end_id\nx,x\n", "Unknown type"), ("n:name\nx\n", "s:start_id,d:end_id\nx,x\n", "should be"), (":id,a:bool\nx,TRUE\n", "s:start_id,d:end_id\nx,x\n", "parse property")])
def test_load_errors(spark, tmp_path, vertices, edges, words):
    (tmp_path / "v").write_text(vertices)
    (tmp_path / "e").write_text(edges)
    with pytest.raises(Exception, match=words):
        Engine(spark).execute(f"LOAD GRAPH WITH VERTICES FROM '{tmp_path}/v' AND EDGES FROM '{tmp_path}/e'")


def test_script_and_store(spark, files):
    engine, _ = load(spark, files)
    said = engine.script("CREATE VIEW COLLECTION c WHERE [w >= 1],[w > 1 and u.ok = true] MANUALLY_ORDERED; /* x */ RUN BASIC COMPUTATION wcc ON COLLECTION c SAVE RESULTS TO '%s/r'; SHOW COMPUTATIONS" % files)
    assert "2 views" in said[0] and "2 views" in said[1] and said[2].endswith("(6) wcc")
    read = lambda path: sorted(r.value for r in spark.read.text(f"{files}/{path}").collect())
    assert read("r/results-full-1.txt") == ["(0, 0), +1", "(3, 0), +1"]
    assert read("r/results-diff-1.txt") == ["(1, 0), -1", "(2, 0), -1"]
    engine.execute(f"SAVE CUBE c TO '{files}/cube' 1 true")
    assert read("cube/fcube-c-full-1.txt") == ["3,0"] and read("cube/fcube-c-diff-0.txt") == ["0 1", "1 2", "3 0"] and read("cube/fcube-c-diff-1.txt") == ["0 1 -1", "1 2 -1"]
    engine.execute(f"SERIALIZE TO '{files}/all'")
    engine.execute(f"SERIALIZE CUBE c TO '{files}/one'")
    with pytest.raises(SerdeError):
        engine.execute(f"DESERIALIZE CUBE FROM '{files}/one'")
    other = Engine(spark)
    other.execute(f"DESERIALIZE FROM '{files}/all'")
    assert other.graph.vertices.count() == 4 and other.collections["c"].size_table() == engine.collections["c"].size_table()
    other.execute("DELETE CUBES")
    other.execute(f"DESERIALIZE CUBE FROM '{files}/one'")
    assert other.collections["c"].texts == ["w >= 1", "w > 1 and u.ok = true"]
    with pytest.raises(SerdeError):
        other.execute(f"DESERIALIZE FROM '{files}/nothing'")
    assert other.graph is None and not other.collections


def test_statement_errors(spark):
    engine = Engine(spark)
    for text, error in (("SAVE GRAPH TO 'x'", LoadGraphError), ("RUN COMPUTATION wcc ON COLLECTION none", CollectionError), ("RUN COMPUTATION tc ON COLLECTION none", ComputationError), ("RUN COMPUTATION wcc FROM 'f' ON COLLECTION none", ComputationError), ("SET THREADS 0 AND PROCESS_ID 0", EngineError)):
        with pytest.raises(error):
            engine.execute(text)


def test_random_cubes_by_language(spark, tmp_path):
    (tmp_path / "g.txt").write_text("\n".join(f"{i},{i + 1}" for i in range(60)))
    engine = Engine(spark, seed=4)
    engine.execute(f"GENERATE CUBE g 20 5 3 4 INITIAL '{tmp_path}/g.txt'")
    engine.execute(f"WINDOW CUBE w 20 4 8 2 2 INITIAL '{tmp_path}/g.txt'")
    assert engine.collections["g"].size_table() == [(20, 0, 20)] + [(5, 3, 22 + 2 * i) for i in range(4)]
    assert engine.collections["w"].size_table() == [(20, 0, 20), (2, 2, 20), (4, 4, 20), (2, 2, 20)]


def test_growing_collection(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    growing = GrowingCollection("s", str(tmp_path / "views"))
    for n, lines in enumerate(["1,2,1\n2,3,1\n", "2,3,-1\n3,4,1\n3,4,1\n3,4,-1\n"]):
        (source / f"{n}.csv").write_text(lines)
        changes = spark.readStream.schema("src long, dst long, diff long").csv(str(source))
        growing.start(changes, str(tmp_path / "state")).awaitTermination()
    made = growing.collection(spark)
    assert made.size_table() == [(2, 0, 2), (1, 1, 2)] and sorted(map(tuple, made.view(1).collect())) == [(1, 2), (3, 4)]
