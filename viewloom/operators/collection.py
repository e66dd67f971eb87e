"""View collections: many filtered snapshots of one graph.

A collection made by conditions keeps one row per edge with a bitmask of its views, in words of 63 bits; full views and
differences come from the bits, without a shuffle. A collection made of differences keeps those. Both give

* ``diffs``: ts, edge_id, src, dst, diff (+1 or -1; the multiplicity for collections of differences),
* ``view_edges``: ts, src, dst for each edge of each view, as often as it occurs,
* ``masks``: src, dst, n and the words (see ``bits``) of some views, a row for an edge of many views: what computations read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.errors import CollectionError
from viewloom.functions.predicates import Compiler, with_endpoints
from viewloom.graph import Graph
from viewloom.lang.ast import Where, text_of
from viewloom.operators.bits import any_set, between, bit, changes, chosen, word_names, words_of, zero
from viewloom.operators.ordering import distances, length, order
from viewloom.operators.timestamps import Timestamps
from viewloom.sources.shared import keep


@dataclass
class Collection:
    """name, timestamps and the conditions' texts in view order."""

    name: str
    timestamps: Timestamps
    texts: list[str] = field(default_factory=list)

    def diffs(self) -> DataFrame:
        raise NotImplementedError

    def view_edges(self, views: Sequence[int] | None = None) -> DataFrame:
        raise NotImplementedError

    def masks(self, views: Sequence[int]) -> DataFrame:
        raise NotImplementedError

    def view(self, ts: int) -> DataFrame:
        return self.view_edges([ts]).select("src", "dst")

    def totals(self) -> DataFrame:
        """ts, adds, dels, edges (of the full view) for each view that has any difference or edge."""
        changed = self.diffs().groupBy("ts").agg(F.sum(F.when(F.col("diff") > 0, F.col("diff")).otherwise(0)).alias("adds"), F.sum(F.when(F.col("diff") < 0, -F.col("diff")).otherwise(0)).alias("dels"))
        full = self.view_edges().groupBy("ts").agg(F.count("*").alias("edges"))
        out = full.join(changed, "ts", "full")
        return out.select("ts", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("adds", "dels", "edges")])

    def size_table(self) -> list[tuple[int, int, int]]:
        """(adds, dels, edges) of each view, on the driver: a row per view."""
        got = {r["ts"]: (r["adds"], r["dels"], r["edges"]) for r in self.totals().collect()}
        return [got.get(i, (0, 0, 0)) for i in range(len(self.timestamps))]


@dataclass
class MaskCollection(Collection):
    """edges: edge_id, src, dst and the mask words, for edges that are in any view."""

    edges: DataFrame = None
    words: list[str] = field(default_factory=list)
    #: The number, from 1, of the condition at each place.
    places: list[int] = field(default_factory=list)

    def view_edges(self, views: Sequence[int] | None = None) -> DataFrame:
        n = len(self.timestamps)
        wanted = F.sequence(F.lit(0), F.lit(n - 1)) if views is None else F.array(*[F.lit(i) for i in views])
        has = F.filter(wanted, lambda i: bit(self.words, i) == 1)
        return self.edges.select(F.explode(has).alias("ts"), "src", "dst")

    def masks(self, views: Sequence[int]) -> DataFrame:
        words = word_names(len(views))
        held = self.edges.select("src", "dst", *chosen(self.words, views)).filter(any_set(words))
        return held.groupBy("src", "dst", *words).agg(F.count("*").alias("n"))

    def diffs(self) -> DataFrame:
        rows = self.edges.select("edge_id", "src", "dst", F.explode(changes(self.words, self.timestamps)).alias("c"))
        return rows.select(F.col("c.ts").alias("ts"), "edge_id", "src", "dst", F.col("c.diff").cast("long").alias("diff"))


@dataclass
class DiffCollection(Collection):
    """changes: ts, src, dst, diff."""

    changes: DataFrame = None

    def diffs(self) -> DataFrame:
        summed = self.changes.groupBy("ts", "src", "dst").agg(F.sum("diff").alias("diff")).filter("diff <> 0")
        return summed.select("ts", F.lit(None).cast("long").alias("edge_id"), "src", "dst", "diff")

    def view_edges(self, views: Sequence[int] | None = None) -> DataFrame:
        holds = F.array(*[F.array(*[F.lit(j) for j in self.timestamps.since(i) if views is None or j in set(views)]).cast("array<int>") for i in range(len(self.timestamps))])
        spread = self.changes.select(F.explode(F.get(holds, F.col("ts"))).alias("ts"), "src", "dst", "diff")
        summed = spread.groupBy("ts", "src", "dst").agg(F.sum("diff").alias("n"))
        negative = F.when(F.col("n") < 0, F.raise_error(F.lit("an edge is deleted more often than added"))).otherwise(F.col("n"))
        return summed.filter("n <> 0").select("ts", "src", "dst", F.explode(F.array_repeat(F.lit(1), negative.cast("int"))).alias("one")).drop("one")

    def masks(self, views: Sequence[int]) -> DataFrame:
        """An edge's changes give stretches of views with the same number of it; layer i has the views with i or more."""
        total = len(self.timestamps)
        each = self.changes.groupBy("src", "dst", "ts").agg(F.sum("diff").alias("diff")).groupBy("src", "dst")
        if len(self.timestamps.lengths) == 1:
            known = each.agg(F.array_sort(F.collect_list(F.struct("ts", "diff"))).alias("c"))
            step = lambda s, x: F.struct((s["n"] + x["diff"]).alias("n"), F.concat(s["out"], F.array(s["n"] + x["diff"])).alias("out"))
            counts = F.aggregate("c", F.struct(zero().alias("n"), F.array().cast("array<bigint>").alias("out")), step, lambda s: s["out"])
            past = F.concat(F.slice(F.transform("c", lambda x: x["ts"]), F.lit(2), F.size("c")), F.array(F.lit(total)))
            stretches = F.arrays_zip(F.transform("c", lambda x: x["ts"]).alias("first"), past.alias("past"), counts.alias("n"))
        else:
            # a view's number is the sum of the changes of all views before it in every dimension
            known = each.agg(F.map_from_entries(F.collect_list(F.struct("ts", "diff"))).alias("c"))
            parts = [F.array(*[F.lit(j) for j in self.timestamps.upto(i)]) for i in range(total)]
            number = lambda i: F.aggregate(F.get(F.array(*parts), i), zero(), lambda s, j: s + F.coalesce(F.try_element_at("c", j), zero()))
            stretches = F.transform(F.sequence(F.lit(0), F.lit(total - 1)), lambda i: F.struct(i.alias("first"), (i + 1).alias("past"), number(i).alias("n")))
        spread = known.select("src", "dst", stretches.alias("s"))
        most = F.aggregate("s", zero(), lambda m, x: F.greatest(m, x["n"]))
        sound = F.when(F.exists("s", lambda x: x["n"] < 0), F.raise_error(F.lit("an edge is deleted more often than added")).cast("bigint")).otherwise(most)
        layers = spread.select("src", "dst", "s", F.explode(F.sequence(F.lit(0).cast("bigint"), sound)).alias("layer")).filter("layer > 0")
        words = [F.aggregate("s", zero(), lambda m, x: m.bitwiseOR(F.when(x["n"] >= F.col("layer"), between(x["first"], x["past"], k)).otherwise(zero()))).alias(w) for k, w in enumerate(word_names(total))]
        held = layers.select("src", "dst", *words)
        held = held.select("src", "dst", *chosen(word_names(total), views))
        return held.filter(any_set(word_names(len(views)))).withColumn("n", F.lit(1).cast("bigint"))


def make_collection(graph: Graph, name: str, dimensions: Sequence[Sequence[Where]], manual: bool = True) -> MaskCollection:
    """The views of a graph in which conditions hold.

    One dimension has a view per condition, ordered to keep differences few unless ``manual`` or fewer than three; more
    dimensions have a view per combination, an edge being in it if all its conditions hold.
    """
    if not 1 <= len(dimensions) <= 3 or not all(dimensions):
        raise CollectionError("a collection has one to three dimensions of one view or more")
    compiler = Compiler(graph, True)
    used = compiler.used(*[w for d in dimensions for w in d])
    joined = with_endpoints(graph, graph.edges, used)
    stamps = Timestamps(tuple(len(d) for d in dimensions))
    holds = [[compiler.where(w) for w in d] for d in dimensions]

    def masked(views: list[Column]) -> DataFrame:
        out = joined.select(F.col("id").alias("edge_id"), F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), *words_of(views))
        return out.filter(any_set(word_names(len(views))))

    words = word_names(len(stamps))
    places = list(range(1, len(stamps) + 1))
    if len(dimensions) == 1:
        views = holds[0]
    else:
        views, texts = [], []
        for ts in stamps.all:
            both = F.lit(True)
            for d, i in enumerate(ts):
                both = both & holds[d][i]
            views.append(both)
            texts.append(" and ".join(text_of(dimensions[d][i]) for d, i in enumerate(ts)))
    edges = keep(masked(views), "collection")
    if len(dimensions) == 1:
        if not manual and len(stamps) >= 3:
            places = order(distances(edges, words, len(stamps)))
            moved = words_of([bit(words, F.lit(p - 1)) == 1 for p in places])
            edges = keep(edges.select("edge_id", "src", "dst", *moved), "collection")
        texts = [text_of(dimensions[0][p - 1]) for p in places]
    return MaskCollection(name, stamps, texts, edges, words, places)


def collection_matrix(graph: Graph, views: Sequence[Where]):
    """The distances between views in the given order, and the differences of that order and of the computed one."""
    made = make_collection(graph, "", [views])
    d = distances(made.edges, made.words, len(views))
    best = order(d)
    return d, length(d, list(range(1, len(d)))), best, length(d, best)
