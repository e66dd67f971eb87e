"""The engine: one graph, its collections, and the statements of the query language."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewloom.errors import CollectionError, ComputationError, EngineError, LoadGraphError, SerdeError
from viewloom.graph import Graph
from viewloom.lang.ast import Statement
from viewloom.lang.parser import parse, parse_where
from viewloom.operators.algorithms import REGISTRY, make
from viewloom.operators.collection import Collection, make_collection
from viewloom.operators.summary import Summary, names, roll_up, summarise
from viewloom.plans import modes
from viewloom.sources import collections as files
from viewloom.sources.graph_csv import load_graph, save_graph, save_mappings


class Engine:
    """Runs statements; ``last`` is what the last one made (a graph, collection, summary or outcome)."""

    def __init__(self, spark: SparkSession, graph: Graph | None = None, seed: int = 0) -> None:
        self.spark, self.graph, self.seed = spark, graph, seed
        self.collections: dict[str, Collection] = {}
        self.last = None

    def execute(self, text: str) -> str:
        """Parse and run one statement; what it reports."""
        statement = parse(text)
        return getattr(self, f"_{statement.kind}")(**statement.args)

    def script(self, text: str) -> list[str]:
        """Run statements separated by ``;``; stops at the first error."""
        return [self.execute(s) for s in split_statements(text)]

    def need_graph(self) -> Graph:
        if self.graph is None:
            raise LoadGraphError("no graph has been loaded")
        return self.graph

    def collection(self, name: str) -> Collection:
        if name not in self.collections:
            raise CollectionError(f"Collection '{name}' has not been created yet")
        return self.collections[name]

    def _add(self, made: Collection) -> None:
        if made.name in self.collections:
            raise CollectionError(f"Collection '{made.name}' already exists in store")
        self.collections[made.name] = self.last = made

    # Python interface beyond the language

    def create_collection(self, name: str, *dimensions: Sequence[str], manual: bool = True) -> Collection:
        """A collection of one to three dimensions of conditions, given as text."""
        if name in self.collections:
            raise CollectionError(f"Collection '{name}' already exists in store")
        self._add(make_collection(self.need_graph(), name, [[parse_where(w) for w in d] for d in dimensions], manual))
        return self.last

    def compute(self, algorithm: str, collection: str, mode: str = "basic", **properties) -> modes.Outcome:
        self.last = modes.run(make(algorithm, properties), self.collection(collection), mode)
        return self.last

    # statements

    def _load_graph(self, vertices, edges, separator, comment, has_headers, mappings, randomize) -> str:
        self.graph = None
        self.graph = self.last = load_graph(self.spark, edges, vertices, separator, comment, has_headers, randomize, self.seed)
        if mappings:
            save_mappings(self.graph, mappings)
        return f"{self.graph.vertices.count()} vertices and {self.graph.edges.count()} edges loaded"

    def _save_graph(self, dir) -> str:
        save_graph(self.need_graph(), dir)
        return f"Graph written to '{dir}'"

    def _serialize(self, name, dir) -> str:
        files.write_store(self.spark, self.graph, self.collections, dir)
        return f"Serialized to '{dir}'"

    def _deserialize(self, dir) -> str:
        self.graph, self.collections = None, {}
        self.graph, self.collections = files.read_store(self.spark, dir)
        return f"Deserialized from '{dir}'"

    def _serialize_cube(self, name, dir) -> str:
        files.write_collection(self.spark, self.collection(name), dir)
        return f"Collection '{name}' serialized to '{dir}'"

    def _deserialize_cube(self, dir) -> str:
        found = files.read_collection(self.spark, dir)
        if found.name in self.collections:
            raise SerdeError(f"Collection '{found.name}' already exists in store")
        self._add(found)
        return f"Collection '{found.name}' deserialized from '{dir}'"

    def _view(self, name, vertices, edges, save_to) -> str:
        self.last = summarise(self.need_graph(), vertices, edges)
        if save_to:
            self.spark.createDataFrame([(line,) for line in dot_lines(self.last, vertices, edges)], "value string").coalesce(1).write.mode("overwrite").text(f"{save_to}/{name}-view.dot")
        return show_summary(self.last, vertices, edges)

    def _aggregated_cube(self, name, vertices, edges, save_to) -> str:
        self.last = roll_up(self.need_graph(), vertices, edges)
        return "\n".join(f"Level {k}:\n{show_summary(s, vertices, edges)}" for k, s in self.last.items())

    def _collection(self, name, views, manual) -> str:
        if name in self.collections:
            raise CollectionError(f"Collection '{name}' already exists in store")
        made = make_collection(self.need_graph(), name, [views], manual)
        self._add(made)
        sizes = made.size_table()
        adds, dels = sum(s[0] for s in sizes), sum(s[1] for s in sizes)
        return f"Collection '{name}' created: {len(sizes)} views, {adds + dels} diffs, {adds} additions, {dels} deletions, {sum(a + d for a, d, _ in sizes[1:])} after the first view"

    def _load_cube(self, name, m, n, dir, prefix, separator, comment, with_full) -> str:
        self._add(files.load_cube(self.spark, name, (n,) if m == 1 else (m, n), dir, prefix, separator, comment, with_full))
        return f"Cube '{name}' loaded successfully"

    def _edges_from(self, path: str) -> DataFrame:
        rows = self.spark.read.schema("src string, dst string").csv(path)
        return rows.select(F.col("src").try_cast("bigint").alias("src"), F.col("dst").try_cast("bigint").alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL")

    def _generate_cube(self, name, numbers, initial) -> str:
        self._add(files.generate_cube(name, self._edges_from(initial), *numbers, seed=self.seed))
        return f"Cube '{name}' loaded successfully"

    def _window_cube(self, name, numbers, initial) -> str:
        self._add(files.window_cube(name, self._edges_from(initial), *numbers, seed=self.seed))
        return f"Cube '{name}' loaded successfully"

    def _save_cube(self, name, dir, threads, bare_first) -> str:
        files.save_cube(self.collection(name), dir, bare_first)
        return f"Cube written to '{dir}'"

    def _delete_cubes(self) -> str:
        self.collections.clear()
        return "All collections deleted"

    def _run(self, mode, adaptive, algorithm, properties, collection, results, save_to, splits, **rest) -> str:
        if rest.get("from"):
            raise ComputationError("computations from files are not supported")
        computation = make(algorithm, properties)
        found = self.collection(collection)
        settings = modes.Adaptive(**{**{"upto": 10, "comp_x": 1.3}, **adaptive})
        self.last = modes.run(computation, found, mode or "adaptive", settings, splits)
        if save_to:
            files.save_results(self.last, save_to, computation.columns)
        took = sum(r.total for r in self.last.runs)
        return f"{algorithm} on '{collection}': {len(found.timestamps)} views in {took:.1f} s" + (f", splits {self.last.splits}" if self.last.splits else "") + f"\n{self.last.report()}"

    def _show_computations(self) -> str:
        return "Computations:\n" + "\n".join(f"({i}) {n}" for i, n in enumerate(sorted(REGISTRY), 1))

    def _show_collections(self) -> str:
        return "Collections:\n" + "\n".join(f"{c.name}: {len(c.timestamps)} views" for c in self.collections.values())

    def _show_data(self, name) -> str:
        found = self.collection(name)
        first = Window.partitionBy("ts").orderBy("src", "dst")
        sample = found.view_edges().distinct().withColumn("n", F.row_number().over(first)).filter("n <= 5")
        shown: dict[int, list] = {}
        for r in sample.orderBy("ts", "n").collect():
            shown.setdefault(r["ts"], []).append(r)
        lines = []
        for i, (adds, dels, total) in enumerate(found.size_table()):
            edges = ",".join(f"({e['src']}, {e['dst']})" for e in shown.get(i, []))
            lines.append(f"{found.timestamps.text(i)}:\n\ttotal: {total}, adds: {adds}, dels: {dels}, sample: {edges}")
        return "\n".join(lines)

    def _set_threads(self, threads, process_id) -> str:
        if threads < 1:
            raise EngineError("threads should be 1 or more")
        self.spark.conf.set("spark.sql.shuffle.partitions", threads)
        return f"Threads set to {threads}, process id to {process_id}"


def split_statements(text: str) -> list[str]:
    """Statements by ``;`` outside of strings and comments."""
    out, now, i = [], "", 0
    while i < len(text):
        if text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i = len(text) if end < 0 else end + 2
            now += " "
        elif text[i] == "'":
            j = i + 1
            while j < len(text) and text[j] != "'":
                j += 2 if text[j] == "\\" else 1
            now, i = now + text[i : j + 1], j + 1
        else:
            if text[i] == ";":
                out.append(now)
                now = ""
            else:
                now += text[i]
            i += 1
    return [s.strip() for s in [*out, now] if s.strip()]


def _values(row, wanted) -> list[str]:
    out = []
    for a in wanted:
        if a.function == "count":
            out.append((a.name, str(row[a.name])))
        else:
            out.append((a.name, f"({row[f'sum_{a.name}']}, {row[f'cnt_{a.name}']})"))
    return out


def _rows(summary: Summary, vertices, edges):
    """Vertices as (number, values, group) and edges as (src, dst, [(section, values)]), streamed in order."""
    ids: dict[int, int] = {}
    nodes = []
    for r in summary.vertices.orderBy(*[c for c in ("section", "parts", "group") if c in summary.vertices.columns]).toLocalIterator():
        ids[r["vid"]] = len(ids)
        section = r["section"] if "section" in summary.vertices.columns else 1
        nodes.append((ids[r["vid"]], _values(r, vertices[section - 1].aggregates) if vertices else [], list(r["group"])))
    links: dict[tuple[int, int], list] = {}
    for r in summary.edges.toLocalIterator():
        wanted = edges[r["section"] - 1].aggregates if edges else []
        links.setdefault((ids[r["src"]], ids[r["dst"]]), []).append((r["section"], _values(r, wanted)))
    return nodes, [(s, d, sorted(links[s, d])) for s, d in sorted(links)]


def show_summary(summary: Summary, vertices, edges) -> str:
    nodes, links = _rows(summary, vertices, edges)
    shown = lambda values: ", ".join(f"{k} = {v}" for k, v in values)
    lines = ["Vertices:", *[f"{i} {{{shown(v)}}}, [{', '.join(g)}]" for i, v, g in nodes], "Edges:"]
    lines += [f"({s}, {d}) [{', '.join(f'{{section = {n}, {shown(v)}}}' for n, v in parts)}]" for s, d, parts in links]
    return "\n".join(lines)


def dot_lines(summary: Summary, vertices, edges) -> list[str]:
    """A GraphViz digraph."""
    nodes, links = _rows(summary, vertices, edges)
    shown = lambda values: ",".join(f"{k}={v}" for k, v in values)
    lines = ["digraph G {", *[f'v{i} [label="{shown(v)},{",".join(g)}"];' for i, v, g in nodes]]
    return [*lines, *[f'v{s} -> v{d} [label="{",".join(f"sec={n},{shown(v)}" for n, v in parts)}"];' for s, d, parts in links], "}"]


__all__ = ["Engine", "dot_lines", "names", "show_summary", "split_statements", "Statement"]
