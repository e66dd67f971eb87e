"""The property graph: vertices (id, properties) and directed edges (id, src, dst, properties), null for an absent property."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from viewloom.errors import ParsingError

#: Rank of a type in comparisons between different types.
RANKS = {"int": 1, "string": 2, "bool": 4, "pair": 5}
_KINDS = {T.LongType: "int", T.IntegerType: "int", T.ShortType: "int", T.StringType: "string", T.BooleanType: "bool"}


def _properties(df: DataFrame, structural: tuple[str, ...]) -> dict[str, str]:
    return {f.name: _KINDS[type(f.dataType)] for f in df.schema if f.name not in structural and type(f.dataType) in _KINDS}


@dataclass
class Graph:
    """``vertices``: id and properties (ext_id is not one); ``edges``: id, src, dst and properties."""

    vertices: DataFrame
    edges: DataFrame

    def vertex_properties(self) -> dict[str, str]:
        return _properties(self.vertices, ("id", "ext_id"))

    def edge_properties(self) -> dict[str, str]:
        return _properties(self.edges, ("id", "src", "dst"))

    def check(self, name: str) -> None:
        """An unknown key is a parse error, whichever side it is used on."""
        if name != "id" and name not in self.vertex_properties() and name not in self.edge_properties():
            raise ParsingError(f"Property '{name}' not found")
