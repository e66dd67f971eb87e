"""Graph summaries: vertices grouped into super-vertices, edges linked anew between them, both aggregated.

A summary is two tables: vertices (section, vid, group, aggregates) and edges (src, dst, section, aggregates). Aggregates
are ``count`` and ``avg``, which is kept as sum_<name> and cnt_<name> so that partial results add up.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.errors import ParsingError
from viewloom.functions.predicates import Compiler, with_endpoints
from viewloom.graph import Graph
from viewloom.lang.ast import Aggregate, Section, Where, text_of


@dataclass
class Summary:
    vertices: DataFrame
    edges: DataFrame


def _aggregates(wanted: Sequence[Aggregate], kinds: dict[str, str], graph: Graph) -> list[Column]:
    out: list[Column] = []
    for a in wanted:
        if a.argument not in ("*", "id"):
            graph.check(a.argument)
        known = a.argument in kinds
        if a.function == "count":
            out.append((F.count(F.lit(1)) if a.argument in ("*", "id") else F.count(a.argument) if known else F.lit(0).cast("long")).alias(a.name))
        else:
            number = F.col("id") if a.argument == "id" else F.col(a.argument).cast("long") if known and kinds[a.argument] == "int" else None
            out.append((F.coalesce(F.sum(number), F.lit(0)) if number is not None else F.lit(0)).cast("long").alias(f"sum_{a.name}"))
            out.append((F.count(number) if number is not None else F.lit(0)).cast("long").alias(f"cnt_{a.name}"))
    return out


def names(wanted: Sequence[Aggregate]) -> list[str]:
    return [n for a in wanted for n in ([a.name] if a.function == "count" else [f"sum_{a.name}", f"cnt_{a.name}"])]


def flatten(clause: list) -> list[list[str | Where]]:
    """A group clause with lists of conditions as the clauses it stands for, one for each choice."""
    return [list(x) for x in itertools.product(*[part if isinstance(part, list) else [part] for part in clause])]


def _shown(kind: str, value: Column) -> Column:
    return F.concat(F.lit("'"), value, F.lit("'")) if kind == "string" else value.cast("string")


def _group_parts(clause: list[str | Where], compiler: Compiler, graph: Graph) -> tuple[Column, list[Column]]:
    """Whether a vertex is in a flattened clause, and its group's parts."""
    kinds = graph.vertex_properties()
    holds, parts = F.lit(True), []
    for part in clause:
        if isinstance(part, str):
            graph.check(part)
            if part == "id":
                value = F.col("id").cast("string")
            else:
                value = F.coalesce(_shown(kinds[part], F.col(part)), F.lit("''")) if part in kinds else F.lit("''")
            parts.append(F.concat(F.lit(f"{part}="), value))
        else:
            holds = holds & compiler.where(part)
            parts.append(F.lit(text_of(part)))
    return holds, parts


def _members(graph: Graph, sections: Sequence[Section]) -> DataFrame:
    """section, group and the vertex's columns, a row for each group that a vertex is in."""
    compiler = Compiler(graph, False)
    own = [F.col(c) for c in graph.vertices.columns]
    if not sections:
        return graph.vertices.select(F.lit(1).alias("section"), F.array(F.concat(F.lit("id="), F.col("id").cast("string"))).alias("group"), *own)
    out = None
    for i, s in enumerate(sections, 1):
        clauses = [c for g in s.groups for c in flatten(g)]
        groups = []
        for clause in clauses or [None]:
            holds, parts = _group_parts(clause, compiler, graph) if clause else (F.lit(True), [F.lit(f"si={i}"), F.concat(F.lit("id="), F.col("id").cast("string"))])
            groups.append(F.when(holds, F.array(*parts)))
        rows = graph.vertices.filter(compiler.where(s.where)).select(F.lit(i).alias("section"), F.explode(F.array_compact(F.array(*groups))).alias("group"), *own)
        out = rows if out is None else out.unionByName(rows)
    return out


def _padded(df: DataFrame, wanted: list[str]) -> DataFrame:
    """All columns of the wanted names; null for those that a section doesn't have."""
    return df.select(*[c for c in df.columns if c not in wanted], *[F.col(c) if c in df.columns else F.lit(None).cast("long").alias(c) for c in wanted])


def _vertex_groups(graph: Graph, sections: Sequence[Section], members: DataFrame, keys: list[str]) -> DataFrame:
    wanted = list(dict.fromkeys(n for s in sections for n in names(s.aggregates)))
    out = None
    for i in range(1, max(1, len(sections)) + 1):
        aggregates = _aggregates(sections[i - 1].aggregates, graph.vertex_properties(), graph) if sections else []
        rows = members.filter(F.col("section") == i).groupBy("section", *keys).agg(F.min("id").alias("__least"), *aggregates)
        rows = _padded(rows, wanted)
        out = rows if out is None else out.unionByName(rows)
    return out


def _linked_edges(graph: Graph, sections: Sequence[Section], labels: dict[str, int], placed: DataFrame) -> DataFrame:
    """src, dst, section and aggregates. placed: id, section, vid of each member."""
    sections = sections or [Section()]
    compiler = Compiler(graph, True)
    wanted = list(dict.fromkeys(n for s in sections for n in names(s.aggregates)))
    used = compiler.used(*[s.where for s in sections])
    edges = with_endpoints(graph, graph.edges, used)
    u = placed.select(F.col("id").alias("src"), F.col("section").alias("__su"), F.col("vid").alias("__u"))
    v = placed.select(F.col("id").alias("dst"), F.col("section").alias("__sv"), F.col("vid").alias("__v"))
    out = None
    for i, s in enumerate(sections, 1):
        if s.groups:
            raise ParsingError("GROUP BY can't be used for edges")
        rows = edges.filter(compiler.where(s.where)).select(*graph.edges.columns).join(u, "src").join(v, "dst")
        if s.between:
            a, b = (labels[x] if x in labels else _unknown(x) for x in s.between)
            rows = rows.filter(((F.col("__su") == a) & (F.col("__sv") == b)) | ((F.col("__su") == b) & (F.col("__sv") == a)))
        rows = rows.groupBy(F.col("__u").alias("__src"), F.col("__v").alias("__dst")).agg(F.lit(i).alias("section"), *_aggregates(s.aggregates, graph.edge_properties(), graph))
        rows = _padded(rows.withColumnsRenamed({"__src": "src", "__dst": "dst"}), wanted)
        out = rows if out is None else out.unionByName(rows)
    return out


def _unknown(label: str):
    raise ParsingError(f"Unknown section label '{label}'")


def _labels(sections: Sequence[Section]) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, s in enumerate(sections, 1):
        if s.label is not None:
            if s.label in out:
                raise ParsingError(f"Section label '{s.label}' is used twice")
            out[s.label] = i
    return out


def summarise(graph: Graph, vertices: Sequence[Section] = (), edges: Sequence[Section] = ()) -> Summary:
    """The summary of a graph by sections of vertices and edges. A super-vertex is numbered by its least member's id and section.

    Edges with an end in no group are left out; an end in several groups links them all.
    """
    labels = _labels(vertices)
    members = _members(graph, vertices)
    groups = _vertex_groups(graph, vertices, members, ["group"])
    numbered = groups.withColumn("vid", F.xxhash64("section", "group"))
    placed = members.select("id", "section", F.xxhash64("section", "group").alias("vid"))
    shown = numbered.select("section", "vid", "group", *[c for c in numbered.columns if c not in ("section", "group", "__least", "vid")])
    return Summary(shown, _linked_edges(graph, edges, labels, placed))


def roll_up(graph: Graph, vertices: Sequence[Section], edges: Sequence[Section]) -> dict[int, Summary]:
    """Summaries by every number of group parts, from all parts of the one group clause down to one.

    Level k has each choice of k parts (``parts``: which), its groups made of the base groups: their counts and sums add up.
    """
    if len(vertices) != 1 or len(vertices[0].groups) != 1:
        raise ParsingError("an aggregated cube needs one vertices section with one group clause")
    if not edges or any(s.between or s.groups for s in edges):
        raise ParsingError("an aggregated cube needs edges sections without BETWEEN and GROUP BY")
    n = len(vertices[0].groups[0])
    base = summarise(graph, vertices, edges)
    nodes, links = base.vertices, base.edges
    added = lambda df, skip: [F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(c) for c in df.columns if c not in skip]]
    out = {}
    for level in range(n, 0, -1):
        chosen = list(itertools.combinations(range(n), level))
        choice = F.explode(F.array(*[F.struct(F.lit(",".join(map(str, c))).alias("parts"), F.array(*[F.get("group", F.lit(i)) for i in c]).alias("g")) for c in chosen]))
        spread = nodes.withColumn("c", choice).withColumns({"parts": F.col("c.parts"), "group": F.col("c.g")}).drop("c")
        spread = spread.withColumn("to", F.xxhash64("parts", "group"))
        grouped = spread.groupBy("parts", "group", F.col("to").alias("vid")).agg(*added(spread, ("section", "vid", "group", "parts", "to"))).drop("__n")
        ends = spread.select("parts", "vid", "to")
        u, v = ends.select("parts", F.col("vid").alias("src"), F.col("to").alias("u")), ends.select("parts", F.col("vid").alias("dst"), F.col("to").alias("v"))
        moved = links.join(u, "src").join(v, ["parts", "dst"])
        linked = moved.groupBy("parts", "u", "v", "section").agg(*added(links, ("src", "dst", "section"))).drop("__n").withColumnsRenamed({"u": "src", "v": "dst"})
        out[level] = Summary(grouped, linked)
    return out
