"""Conditions on a small graph, by the ids of the edges they hold for."""

import pytest

from viewloom.errors import ParsingError
from viewloom.functions.predicates import Compiler, filter_edges
from viewloom.graph import Graph
from viewloom.lang.parser import parse_where


@pytest.fixture(scope="module")
def graph(spark):
    vertices = [(0, "waterloo", "M", True, True), (1, "toronto", "M", False, False), (2, "toronto", "F", True, False), (3, "montreal", "M", False, False), (4, "seattle", "F", True, False), (5, "seattle", "F", True, False), (6, "boston", "F", True, True), (7, "boston", "F", False, True)]
    edges = [(0, 2, 1, 400, 2008, True), (1, 0, 1, 100, 2000, True), (2, 0, 2, 200, 2018, False), (3, 3, 2, 200, 2000, True), (4, 6, 7, 4000, 2010, True), (5, 4, 5, 600, 2000, False), (6, 3, 7, 600, 2005, False)]
    return Graph(spark.createDataFrame(vertices, "id long, city string, gender string, include boolean, include2 boolean"), spark.createDataFrame(edges, "id long, src long, dst long, amount long, year long, include boolean"))


ALL = list(range(7))


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("amount <= 200", [1, 2, 3]),
        ("amount > year", [4]),
        ("amount > e", []),
        ("year >= u.id", ALL),
        ("include = v.include", [3, 6]),
        ("e = (6,7)", [4]),
        ("e <> id", ALL),
        ("e = e", ALL),
        ("e <> e", []),
        ("u.city = 'waterloo'", [1, 2]),
        ("u.include <> include", [2, 3, 5]),
        ("u.include <> u.include2", [0, 5]),
        ("u.gender = v.gender", [1, 4, 5]),
        ("v.include2 <> include", [0, 1, 3, 6]),
        ("v.gender <> u.gender", [0, 2, 3, 6]),
        ("v.include = v.include2", [0, 1]),
        ("amount >= 200 and !(year = 2000 and include = true)", [0, 2, 4, 5, 6]),
        ("city = 'boston'", []),  # a vertex property is absent from edges
        ("!(city = 'boston')", ALL),
        ("city <> 'boston'", []),
        ("amount < 'x'", ALL),  # by the rank of types
        ("include > 'x'", ALL),
    ],
)
def test_edges(graph, text, ids):
    assert sorted(r.id for r in filter_edges(graph, parse_where(text)).collect()) == ids


def test_unused_endpoints_are_not_joined(graph):
    assert "Join" not in filter_edges(graph, parse_where("amount <= 200"))._jdf.queryExecution().executedPlan().toString()


def test_errors(graph):
    for text in ("nothing = 1", "u.nothing = 1", "w.id = 1", "amount ~ 1", "amount ="):
        with pytest.raises(ParsingError):
            filter_edges(graph, parse_where(text))
    with pytest.raises(ParsingError):
        Compiler(graph, False).where(parse_where("u.city = 'x'"))
