"""Conditions compiled to Spark columns.

Values of different types compare by the rank of their types; a comparison with an absent property is false, so a negated
group with one is true. No implicit casts happen.
"""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.errors import ParsingError
from viewloom.graph import RANKS, Graph
from viewloom.lang.ast import Predicate, Value, Variable, Where

_COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "=": operator.eq, "<>": operator.ne}


def _literal(value: Value) -> tuple[str, Column]:
    if isinstance(value, bool):
        return "bool", F.lit(value)
    if isinstance(value, int):
        return "int", F.lit(value).cast("bigint")
    if isinstance(value, str):
        return "string", F.lit(value)
    return "pair", F.struct(F.lit(value[0]).cast("bigint").alias("a"), F.lit(value[1]).cast("bigint").alias("b"))


class Compiler:
    """Compiles conditions on the edges or the vertices of a graph."""

    def __init__(self, graph: Graph, edges: bool) -> None:
        self.graph, self.edges = graph, edges

    def _operand(self, x: Variable | Value) -> tuple[str, Column] | None:
        """Type and column; None if no row has it."""
        if not isinstance(x, Variable):
            return _literal(x)
        if not self.edges and (x.side or x.name == "e"):
            raise ParsingError(f"'{x}' can't be used for vertices")
        if x.side:
            self.graph.check(x.name)
            kinds = self.graph.vertex_properties()
            if x.name == "id":
                return "int", F.col("src" if x.side == "u" else "dst").cast("bigint")
            return (kinds[x.name], F.col(f"__{x.side}_{x.name}")) if x.name in kinds else None
        if x.name == "e":
            return "pair", F.struct(F.col("src").cast("bigint").alias("a"), F.col("dst").cast("bigint").alias("b"))
        self.graph.check(x.name)
        if x.name == "id":
            return "int", F.col("id").cast("bigint")
        kinds = self.graph.edge_properties() if self.edges else self.graph.vertex_properties()
        return (kinds[x.name], F.col(x.name)) if x.name in kinds else None

    def predicate(self, p: Predicate) -> Column:
        left, right = self._operand(p.left), self._operand(p.right)
        if left is None or right is None:
            return F.lit(False)
        compare = _COMPARE[p.op]
        if left[0] != right[0]:
            return left[1].isNotNull() & right[1].isNotNull() if compare(RANKS[left[0]], RANKS[right[0]]) else F.lit(False)
        if left[0] == "int":
            left, right = (left[0], left[1].cast("bigint")), (right[0], right[1].cast("bigint"))
        return F.coalesce(compare(left[1], right[1]), F.lit(False))

    def where(self, where: Where) -> Column:
        out = F.lit(True)
        for c in where:
            both = F.lit(True)
            for p in c.predicates:
                both = both & self.predicate(p)
            out = out & (~both if c.negated else both)
        return out

    def used(self, *wheres: Where) -> dict[str, set[str]]:
        """The vertex properties that conditions on edges look up, by side."""
        out: dict[str, set[str]] = {"u": set(), "v": set()}
        for where in wheres:
            for c in where:
                for p in c.predicates:
                    for x in (p.left, p.right):
                        if isinstance(x, Variable) and x.side and x.name in self.graph.vertex_properties():
                            out[x.side].add(x.name)
        return out


def with_endpoints(graph: Graph, edges: DataFrame, used: dict[str, set[str]]) -> DataFrame:
    """``edges`` with the used properties of sources and targets; nothing is joined if none is used."""
    for side, key in (("u", "src"), ("v", "dst")):
        if used[side]:
            looked = graph.vertices.select(F.col("id").alias(key), *[F.col(n).alias(f"__{side}_{n}") for n in sorted(used[side])])
            edges = edges.join(looked, key, "left")
    return edges


def filter_edges(graph: Graph, where: Where) -> DataFrame:
    """The edges a condition holds for."""
    c = Compiler(graph, True)
    return with_endpoints(graph, graph.edges, c.used(where)).filter(c.where(where)).select(*graph.edges.columns)
