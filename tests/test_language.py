"""Statements, their options in any order, and what is no statement."""

import pytest

from viewloom.engine import split_statements
from viewloom.errors import ParsingError
from viewloom.lang.parser import parse


def test_statements():
    assert parse("load graph WITH EDGES FROM 'e' HAS_HEADERS false RANDOMIZE SEPARATOR '|';").args == {"vertices": None, "edges": "e", "separator": "|", "comment": None, "has_headers": False, "mappings": None, "randomize": True}
    assert parse("LOAD CUBE c 1 4 FROM 'd' WITH PREFIX 'p' THREADS 3 WITH_FULL").args["with_full"]
    assert parse("GENERATE CUBE c 1 2 3 4 INITIAL 'g'").args["numbers"] == [1, 2, 3, 4]
    assert parse("WINDOW CUBE c 1 2 3 4 5 INITIAL 'g'").args["numbers"] == [1, 2, 3, 4, 5]
    assert parse("SET THREADS 2 AND PROCESS_ID 0").args == {"threads": 2, "process_id": 0}
    assert parse("SHOW DATA FOR COLLECTION 'c'").args == {"name": "c"}
    assert parse("SAVE CUBE c TO 'd' 2 true").args["bare_first"]
    assert parse("SERIALIZE CUBE c TO 'd' BLOCK_SIZE 10 THREADS 2").kind == "serialize_cube"
    assert parse("DESERIALIZE FROM 'd' THREADS 2").kind == "deserialize"
    assert parse("RUN basic_individual COMPUTATION wcc ON COLLECTION c HOSTS 'h:1' 'h:2'").args["mode"] == "basic_individual"
    got = parse("RUN ADAPTIVE UPTO 5 COMP_X 1.5 DIFF_X 1.0 LIMIT 5 ALGO avg COMPUTATION sssp(root=1 weight_cap=-2,) ON COLLECTION c SAVE RESULTS TO 'd' INDICES []").args
    assert got["adaptive"] == {"upto": 5, "comp_x": 1.5, "diff_x": 1.0, "limit": 5, "algo": "avg"}
    assert got["properties"] == {"root": 1, "weight_cap": -2} and got["splits"] == [] and got["save_to"] == "d"


def test_collections_and_views():
    got = parse("CREATE VIEW COLLECTION c WHERE [a <= 1 and !(u.b = 'x' and v.c <> true)], [e = (1, -2)] MATERIALIZED MANUALLY_ORDERED").args
    assert got["manual"] and [" and ".join(map(str, w)) for w in got["views"]] == ["a <= 1 and !(u.b = 'x' and v.c <> true)", "e = (1, -2)"]
    got = parse("CREATE VIEW v WITH VERTICES AS A WHERE f = 1 GROUP BY [(p, [f=1][f=2]), (q)] AGGREGATE {n: count(*), m: avg(f)} EDGES BETWEEN (A, A) AGGREGATE {n: count(*)} SAVE TO 'd'").args
    assert got["vertices"][0].label == "A" and len(got["vertices"][0].groups) == 2 and got["edges"][0].between == ("A", "A") and got["save_to"] == "d"
    assert parse("CREATE AGGREGATED CUBE v WITH VERTICES GROUP BY (p, q) EDGES").kind == "aggregated_cube"


@pytest.mark.parametrize(
    "text",
    ["", "LOAD", "LOADGRAPH WITH EDGES FROM 'e'", "LOAD GRAPH WITH EDGES FROM ''", "CREATE VIEW v WITH VERTICES AGGREGATE {m: avg(*)}", "CREATE VIEW v WITH VERTICES AGGREGATE {m: max(f)}", "RUN COMPUTATION wcc ON c", "SET THREADS 01 AND PROCESS_ID 0", "CREATE VIEW COLLECTION c WHERE []", "DELETE CUBES x", "RUN ADAPTIVE COMPUTATION wcc ON COLLECTION c", "SHOW 'x"],
)
def test_not_statements(text):
    with pytest.raises(ParsingError) as e:
        parse(text)
    assert str(e.value).startswith("[ParsingError]")


def test_scripts():
    assert split_statements("a 'x;y' /* ; */ b; ;c") == ["a 'x;y'   b", "c"]
