"""Graph summaries against plain Python, and what they show."""

import itertools

import pytest

from viewloom.engine import Engine
from viewloom.errors import ParsingError
from viewloom.graph import Graph
from viewloom.lang.parser import parse
from viewloom.operators.summary import flatten, roll_up, summarise

VERTICES = [(0, "F", "Eng", "WA"), (1, "M", "Doc", "WA"), (2, "F", "Eng", "ON"), (3, "M", None, "ON"), (4, "F", "Doc", "NY"), (5, "M", "Eng", None)]
EDGES = [(0, 0, 1, 5), (1, 0, 2, 7), (2, 1, 3, 1), (3, 3, 0, 9), (4, 4, 5, 2), (5, 5, 5, 4), (6, 2, 4, None), (7, 0, 1, 6)]


@pytest.fixture(scope="module")
def graph(spark):
    return Graph(spark.createDataFrame(VERTICES, "id long, gender string, work string, state string"), spark.createDataFrame(EDGES, "id long, src long, dst long, w long"))


def sections(text):
    return parse(f"CREATE VIEW v WITH {text}").args


def groups(made):
    return {r.vid: ("|".join(r.group), *[r[c] for c in made.vertices.columns if c not in ("vid", "group", "section", "parts")]) for r in made.vertices.collect()}


def test_group_by_properties(graph):
    a = sections("VERTICES GROUP BY (gender, state) AGGREGATE {n: count(*), w: count(work)} EDGES WHERE w > 1 AGGREGATE {n: count(*), m: avg(w)}")
    made = summarise(graph, a["vertices"], a["edges"])
    name = lambda v: f"gender='{v[1]}'|state='{v[3] or ''}'"
    want = {name(v): (sum(name(x) == name(v) for x in VERTICES), sum(name(x) == name(v) and x[2] is not None for x in VERTICES)) for v in VERTICES}
    got = groups(made)
    assert {g[0]: g[1:] for g in got.values()} == want
    links = {}
    for _, s, d, w in EDGES:
        if w is not None and w > 1:
            n, t, c = links.get((name(VERTICES[s]), name(VERTICES[d])), (0, 0, 0))
            links[name(VERTICES[s]), name(VERTICES[d])] = (n + 1, t + w, c + 1)
    assert {(got[r.src][0], got[r.dst][0]): (r.n, r.sum_m, r.cnt_m) for r in made.edges.collect()} == links


def test_without_sections(graph):
    made = summarise(graph)
    assert sorted(g[0] for g in groups(made).values()) == [f"id={i}" for i in range(6)] and made.edges.count() == 7


def test_a_vertex_in_several_groups(graph):
    a = sections("VERTICES GROUP BY [([gender = 'F'][work = 'Eng']), (state)] AGGREGATE {n: count(id)} EDGES AGGREGATE {n: count(*)}")
    made = summarise(graph, a["vertices"], a["edges"])
    member = lambda v: (["gender = 'F'"] if v[1] == "F" else []) + (["work = 'Eng'"] if v[2] == "Eng" else []) + [f"state='{v[3] or ''}'"]
    got = groups(made)
    assert {g[0]: g[1] for g in got.values()} == {k: sum(k in member(v) for v in VERTICES) for v in VERTICES for k in member(v)}
    want = {}
    for _, s, d, _ in EDGES:
        for pair in itertools.product(member(VERTICES[s]), member(VERTICES[d])):
            want[pair] = want.get(pair, 0) + 1
    assert {(got[r.src][0], got[r.dst][0]): r.n for r in made.edges.collect()} == want
    assert len(flatten(a["vertices"][0].groups[0])) == 2


def test_between(graph):
    a = sections("VERTICES AS A WHERE gender = 'F' GROUP BY (gender) VERTICES AS B WHERE gender = 'M' GROUP BY (gender) EDGES BETWEEN (A, B) AGGREGATE {n: count(*)}")
    got = summarise(graph, a["vertices"], a["edges"])
    assert sorted(r.n for r in got.edges.collect()) == [1, 3]  # either way
    for text in ("VERTICES AS A VERTICES AS A EDGES", "VERTICES AS A EDGES BETWEEN (A, C)", "VERTICES EDGES GROUP BY (w)", "VERTICES AGGREGATE {n: count(nothing)} EDGES"):
        with pytest.raises(ParsingError):
            a = sections(text)
            summarise(graph, a["vertices"], a["edges"])


def test_roll_up_has_every_choice_of_parts(graph):
    a = sections("VERTICES GROUP BY (gender, work, state) AGGREGATE {n: count(*)} EDGES AGGREGATE {n: count(*), m: avg(w)}")
    levels = roll_up(graph, a["vertices"], a["edges"])
    assert sorted(levels) == [1, 2, 3]
    for level, made in levels.items():
        got = groups(made)
        want, links = {}, {}
        for parts in itertools.combinations(range(3), level):
            name = lambda v, parts=parts: "|".join(f"{('gender', 'work', 'state')[p]}='{v[p + 1] or ''}'" for p in parts)
            for v in VERTICES:
                want[name(v)] = want.get(name(v), 0) + 1
            for _, s, d, w in EDGES:
                n, t, c = links.get((name(VERTICES[s]), name(VERTICES[d])), (0, 0, 0))
                links[name(VERTICES[s]), name(VERTICES[d])] = (n + 1, t + (w or 0), c + (w is not None))
        assert {g[0]: g[1] for g in got.values()} == want
        assert {(got[r.src][0], got[r.dst][0]): (r.n, r.sum_m, r.cnt_m) for r in made.edges.collect()} == links
    with pytest.raises(ParsingError):
        roll_up(graph, sections("VERTICES EDGES")["vertices"], a["edges"])


def test_shown(spark, graph, tmp_path):
    engine = Engine(spark, graph)
    said = engine.execute(f"CREATE VIEW v WITH VERTICES GROUP BY (gender) AGGREGATE {{n: count(*)}} EDGES AGGREGATE {{n: count(*), m: avg(w)}} SAVE TO '{tmp_path}'")
    assert said.splitlines() == ["Vertices:", "0 {n = 3}, [gender='F']", "1 {n = 3}, [gender='M']", "Edges:", "(0, 0) [{section = 1, n = 2, m = (7, 1)}]", "(0, 1) [{section = 1, n = 3, m = (13, 3)}]", "(1, 0) [{section = 1, n = 1, m = (9, 1)}]", "(1, 1) [{section = 1, n = 2, m = (5, 2)}]"]
    lines = [r.value for r in spark.read.text(f"{tmp_path}/v-view.dot").collect()]
    assert lines[0] == "digraph G {" and "v0 -> v1 [label=\"sec=1,n=3,m=(13, 3)\"];" in lines
    assert engine.execute("CREATE AGGREGATED CUBE c WITH VERTICES GROUP BY (gender, state) EDGES").count("Level") == 2
