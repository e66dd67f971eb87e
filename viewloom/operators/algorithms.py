"""Graph algorithms over all views of a collection at once.

Edges come once with the words of their views (see ``bits``), and so do all intermediate rows: a row of a frontier, of a
label or of a distance stands for all views that have it, so a superstep costs what the views differ in, not their number.
Every superstep is one job for all views; its table is written, so that plans stay short and a lost executor costs a
reread, and deleted as soon as the next one is written. Views end on their own: a view without changes adds no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.errors import ComputationError, InitError
from viewloom.operators.bits import BITS, Masked, any_set, both, expand, full, least_first, prefixed, united, word_names, zero
from viewloom.sources.shared import forget, keep, keep_measured


@dataclass
class ViewInput:
    """The edges of some views: ``edges`` has src, dst, n (how often) and the words of ``views``."""

    edges: DataFrame
    views: Sequence[int]
    _kept: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def words(self) -> list[str]:
        return word_names(len(self.views))

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = keep(make(), name)
        return self._kept[name]

    def rows(self) -> DataFrame:
        """src, dst, n, words: the edges as often as they occur, read from the shared folder."""
        return self._once("edges", lambda: self.edges)

    def masked(self) -> DataFrame:
        """src, dst, words: a row for each distinct edge."""
        return self._once("links", lambda: self.edges.groupBy("src", "dst").agg(*united(self.words)))

    def all(self) -> DataFrame:
        """ts, src, dst: a row for each edge of each view, for computations that don't read words."""
        return expand(self.rows(), self.words, self.views).select("ts", "src", "dst", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))).alias("one")).drop("one")


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


#: Tables of new rows that are read together before they are written as one.
MOST_PARTS = 8


def _unreached(active: DataFrame, done: dict[int, list[int]], words: list[str]) -> DataFrame:
    """The frontier without the views that reached all goals of their root; ``done`` has a row for each root of the statement."""
    finished = {r: w for r, w in done.items() if any(w)}
    if not finished:
        return active
    masks = active.sparkSession.createDataFrame([(r, *w) for r, w in finished.items()], ", ".join(["root long", *[f"d{w} long" for w in words]]))
    left = active.join(F.broadcast(masks), "root", "left")
    return left.select("root", "v", *[F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"d{w}", zero()))).alias(w) for w in words]).filter(any_set(words))


def hops(data: ViewInput, roots: Sequence[int], goals: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """root, v, dist, words: the fewest edges from each root, in every view; a root reaches itself.

    A row of the frontier stands for all views that reach it at once. With goals, a root stops in a view as soon as all its
    goals are reached there. What was seen meets what is met in one aggregation, by vertex, so no row is looked up in a table.
    """
    edges, words = data.masked(), data.words
    spark = edges.sparkSession
    start = spark.createDataFrame([(r,) for r in dict.fromkeys(roots)], "root long")
    frontier = keep(start.select("root", F.col("root").alias("v"), *full(len(data.views))), "frontier")
    reached = [frontier.withColumn("dist", zero())]
    parts, compacted = [frontier], None
    by_root: dict[int, dict[int, list[int]]] = {}
    for r, v in goals or ():
        by_root.setdefault(r, {})[v] = [(1 << min(BITS, len(data.views) - BITS * k)) - 1 if r == v else 0 for k in range(len(words))]
    wanted = F.broadcast(spark.createDataFrame(list(dict.fromkeys(goals)), "root long, v long")) if goals else None
    links = edges.select(F.col("src").alias("v"), "dst", *prefixed(words, "e"))
    empty = [zero().alias(f"o{w}") for w in words]
    dist = 0
    while True:
        dist += 1
        active = frontier
        if goals:
            active = _unreached(active, {r: [reduce(lambda a, b: a & b, column) for column in zip(*got.values())] for r, got in by_root.items()}, words)
        met = active.join(links, "v").select("root", F.col("dst").alias("v"), *both(words, "e")).filter(any_set(words))
        if len(parts) > MOST_PARTS:
            parts, old = [keep(_union(parts).groupBy("root", "v").agg(*united(words)), "seen")], compacted
            compacted = parts[0]
            forget(old)
        seen = _union(parts).select("root", "v", *[zero().alias(w) for w in words], *prefixed(words, "o"))
        met = met.select("root", "v", *words, *empty).unionByName(seen).groupBy("root", "v").agg(*united(words), *united(words, "o"))
        new = met.select("root", "v", *[F.col(w).bitwiseAND(F.bitwise_not(f"o{w}")).alias(w) for w in words]).filter(any_set(words))
        frontier, got = keep_measured(new, "frontier")
        if not got["n"]:
            forget(compacted)
            return _union(reached)
        if wanted is not None:
            for row in frontier.join(wanted, ["root", "v"]).collect():  # a row for each goal of the statement at most
                mine = by_root[row["root"]]
                mine[row["v"]] = [a | row[w] for a, w in zip(mine[row["v"]], words)]
        reached.append(frontier.withColumn("dist", F.lit(dist).cast("long")))
        parts.append(frontier)


class Computation:
    """An algorithm: ``run`` gives a ``Masked`` result, or a table of ts, the columns of its rows, and diff, their multiplicity."""

    name = ""
    columns: tuple[str, ...] = ()
    #: Parameter -> type: int, bool, string or pairs.
    parameters: dict[str, str] = {}

    def __init__(self, **properties) -> None:
        if len(properties) != len(self.parameters):
            raise InitError(f"{self.name} needs {len(self.parameters)} properties {sorted(self.parameters)}, but found {len(properties)}")
        for key, kind in self.parameters.items():
            if key not in properties:
                raise InitError(f"{self.name} needs property '{key}' but found {sorted(properties)}")
            value = properties[key]
            if kind == "pairs" and isinstance(value, tuple):
                value = [value]
            if not _KINDS[kind](value):
                raise InitError(f"{self.name} property '{key}' should be '{kind}' but found '{properties[key]}'")
            setattr(self, key, value)

    def run(self, data: ViewInput) -> Masked | DataFrame:
        raise NotImplementedError


_KINDS: dict[str, Callable[[object], bool]] = {
    "int": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "bool": lambda v: isinstance(v, bool),
    "string": lambda v: isinstance(v, str),
    "pairs": lambda v: isinstance(v, list) and all(isinstance(p, tuple) and len(p) == 2 for p in v),
}

#: Algorithms by name.
REGISTRY: dict[str, type[Computation]] = {}


def register(cls: type[Computation]) -> type[Computation]:
    REGISTRY[cls.name] = cls
    return cls


def make(name: str, properties: dict) -> Computation:
    if name not in REGISTRY:
        raise ComputationError(f"Unknown computation type '{name}'")
    return REGISTRY[name](**properties)


def _once(df: DataFrame, data: ViewInput) -> Masked:
    return Masked(df.withColumn("diff", F.lit(1).cast("long")), data.views)


@register
class Bfs(Computation):
    """Fewest hops from the root along edges; the root is in every view's result, at 0."""

    name, columns, parameters = "bfs", ("v", "dist"), {"root": "int"}

    def run(self, data: ViewInput) -> Masked:
        return _once(hops(data, [self.root]).select("v", "dist", *data.words), data)


@register
class Sssp(Computation):
    """Least sum of weights from the root; an edge weighs ((src + dst) mod weight_cap) + 1."""

    name, columns, parameters = "sssp", ("v", "dist"), {"root": "int", "weight_cap": "int"}

    def run(self, data: ViewInput) -> Masked:
        if self.weight_cap < 1:
            raise InitError("sssp property 'weight_cap' should be 1 or more")
        words = data.words
        edges = data.masked()
        links = edges.select(F.col("src").alias("v"), "dst", (F.pmod(F.col("src") + F.col("dst"), F.lit(self.weight_cap)) + 1).cast("long").alias("weight"), *prefixed(words, "e"))
        start = edges.sparkSession.createDataFrame([(self.root, 0)], "v long, dist long").select("v", "dist", *full(len(data.views)))
        improved = keep(start, "improved")
        parts = [improved]
        while True:
            step = improved.join(links, "v").select(F.col("dst").alias("v"), (F.col("dist") + F.col("weight")).alias("dist"), *both(words, "e")).filter(any_set(words))
            step = step.groupBy("v", "dist").agg(*united(words)).withColumn("new", F.lit(1))
            # a view's row is new only if no known distance and no smaller new one has it
            met = least_first(step.unionByName(_union(parts).withColumn("new", F.lit(0))), "v", "dist", words, mark="new")
            improved, got = keep_measured(met.filter("new = 1").drop("new"), "improved")
            if not got["n"]:
                best = keep(least_first(_union(parts), "v", "dist", words), "best")
                forget(*parts, improved)
                return _once(best, data)
            parts.append(improved)
            if len(parts) > MOST_PARTS:
                old, parts = parts[:-1], [keep(least_first(_union(parts[:-1]), "v", "dist", words), "best"), improved]
                forget(*old)


def _state(words: Sequence[str], *columns: str) -> Column:
    """An aggregate that tells sets of distinct rows apart."""
    return F.sum(F.xxhash64(*columns, *words).cast("decimal(38,0)"))


def connect(links: DataFrame, words: list[str]) -> DataFrame:
    """v, label, words of every end of ``links`` (u, v, words): the least vertex of its component in each view, by alternating large and small stars.

    A star's least end differs from view to view; a row stands for the views in which it is the same.
    """
    ends = links.select(F.explode(F.array("u", "v")).alias("v"), *words).groupBy("v").agg(*united(words))
    first = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), *words)
    edges, state = keep(first.groupBy("u", "v").agg(*united(words)), "stars"), None
    while True:
        both_ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *words))
        least = both_ways.select("u", F.least("u", "v").alias("m"), *words).groupBy("u", "m").agg(*united(words))
        least = least_first(least, "u", "m", words, wide=state is None)
        up = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *prefixed(words, "e"))  # from u to greater ends
        large = up.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), *both(words, "e")).filter(any_set(words))
        large = keep(large.groupBy("u", "v").agg(*united(words)), "stars")
        least = least_first(large.withColumnRenamed("v", "m"), "u", "m", words, wide=state is None)
        down = large.select("u", "v", *prefixed(words, "e")).join(least, "u").select("u", "v", "m", *both(words, "e")).filter(any_set(words))
        small = down.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"), *words)
        small = small.select("e.u", "e.v", *words).filter("u <> v").groupBy("u", "v").agg(*united(words))
        before = edges
        edges, got = keep_measured(small, "stars", state=_state(words, "u", "v"))
        forget(before, large)
        if (got["n"], got["state"]) == state:
            break
        state = got["n"], got["state"]
    # in the end each vertex but the least of a component has one link, to that one
    labels = edges.select(F.col("u").alias("v"), F.col("v").alias("label"), *words)
    rest = ends.join(labels.groupBy("v").agg(*united(words)).select("v", *prefixed(words, "o")), "v", "left")
    own = rest.select("v", F.col("v").alias("label"), *[F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"o{w}", zero()))).alias(w) for w in words]).filter(any_set(words))
    out = keep(labels.unionByName(own), "labels")
    forget(edges)
    return out


@register
class Wcc(Computation):
    """The least vertex of each vertex's component, edges taken as undirected."""

    name, columns = "wcc", ("v", "label")

    def run(self, data: ViewInput) -> Masked:
        return _once(connect(data.masked().withColumnsRenamed({"src": "u", "dst": "v"}), data.words), data)


def _ancestors(links: DataFrame, words: list[str]) -> DataFrame:
    """v, label, words: the least vertex from which v is reached along ``links`` (src, dst, words), itself included.

    A vertex takes the least label of those that link to it, and the label of its label, whose ancestors are its own; so
    long paths take few rounds.
    """
    own = links.select(F.explode(F.array("src", "dst")).alias("v"), *words).groupBy("v").agg(*united(words))
    labels, total = keep(own.select("v", F.col("v").alias("label"), *words), "labels"), None
    along = links.select(F.col("src").alias("v"), "dst", *prefixed(words, "e"))
    bits = lambda: reduce(lambda a, b: a + b, [F.bit_count(w) for w in words])
    while True:
        told = labels.join(along, "v").select(F.col("dst").alias("v"), "label", *both(words, "e")).filter(any_set(words))
        far = labels.select(F.col("v").alias("mid"), F.col("label").alias("far"), *prefixed(words, "e"))
        jumped = labels.filter("v <> label").join(far, F.col("label") == F.col("mid")).filter("far <> label").select("v", F.col("far").alias("label"), *both(words, "e")).filter(any_set(words))
        met = _union([labels, told, jumped]).groupBy("v", "label").agg(*united(words))
        before = labels
        labels, got = keep_measured(least_first(met, "v", "label", words, wide=total is None), "labels", total=F.sum(F.col("label").cast("decimal(30,0)") * bits()))
        forget(before)
        if got["total"] == total:  # labels only fall
            return labels
        total = got["total"]


def _same(links: DataFrame, labels: DataFrame, name: str, words: list[str]) -> DataFrame:
    """The links in the views in which their ends have the same label, with it."""
    at = lambda end: labels.select(F.col("v").alias(end), F.col("label").alias(name), *prefixed(words, "e"))
    near = links.join(at("src"), "src").select(*[c for c in links.columns if c not in words], name, *both(words, "e")).filter(any_set(words))
    return near.join(at("dst"), ["dst", name]).select(*[c for c in near.columns if c not in words], *both(words, "e")).filter(any_set(words))


def _trimmed(links: DataFrame, words: list[str]) -> DataFrame:
    """Links without those at a vertex that none enters or none leaves, which no cycle holds; a few rounds suffice to help."""
    for _ in range(3):
        into = links.groupBy(F.col("dst").alias("src")).agg(*united(words)).select("src", *prefixed(words, "i"))
        out = links.groupBy(F.col("src").alias("dst")).agg(*united(words)).select("dst", *prefixed(words, "o"))
        left = links.join(into, "src").join(out, "dst")
        before = links
        links = keep(left.select("src", "dst", *[F.col(w).bitwiseAND(F.col(f"i{w}")).bitwiseAND(F.col(f"o{w}")).alias(w) for w in words]).filter(any_set(words)), "trimmed")
        forget(before)
    return links


@register
class Scc(Computation):
    """The edges, as often as they occur, whose ends are in one strongly connected component."""

    name, columns = "scc", ("src", "dst")

    def run(self, data: ViewInput) -> Masked:
        """Each round colours a vertex by its least ancestor, keeps edges of one colour, and colours them against their
        direction. Edges with the same colour both ways are the component of that vertex and are done; the rest go on."""
        words = data.words
        inside = [data.masked().filter("src = dst").select("src", "dst", *words)]
        left = _trimmed(data.masked().filter("src <> dst").select("src", "dst", *words), words)
        while not left.isEmpty():
            forward = _ancestors(left, words)
            forth = keep(_same(left, forward, "f", words), "colours")
            forget(left, forward)
            backward = _ancestors(forth.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *words).groupBy("src", "dst").agg(*united(words)), words)
            back = keep(_same(forth, backward, "b", words), "colours")
            forget(forth, backward)
            inside.append(back.filter("f = b").select("src", "dst", *words))
            rest = back.filter("f <> b").select("src", "dst", *words).groupBy("src", "dst").agg(*united(words))
            left = _trimmed(rest, words)
        cycles = _union(inside).groupBy("src", "dst").agg(*united(words)).select("src", "dst", *prefixed(words, "e"))
        found = data.rows().join(cycles, ["src", "dst"]).select("src", "dst", F.col("n").alias("diff"), *both(words, "e"))
        return Masked(found.filter(any_set(words)), data.views, adds=True)


@register
class Mpsp(Computation):
    """The fewest hops of each goal (source, target) that is reached; a goal from a vertex to itself has 0."""

    name, columns, parameters = "mpsp", ("src", "dst", "len"), {"goals": "pairs"}

    def run(self, data: ViewInput) -> Masked:
        goals = list(dict.fromkeys(self.goals))
        found = hops(data, [s for s, _ in goals], goals)
        wanted = found.sparkSession.createDataFrame(goals, "root long, v long")  # as many rows as the statement has goals
        near = found.join(F.broadcast(wanted), ["root", "v"])
        return _once(near.select(F.col("root").alias("src"), F.col("v").alias("dst"), F.col("dist").alias("len"), *data.words), data)


@register
class PageRank(Computation):
    """Integer surfer rank as the vertex's multiplicity: 6 000 000 at first, then 1 000 000 and from each edge 5/6 of the
    source's rank by its out-degree, cut to an integer. Parallel edges count; 0 iterations go on until nothing changes.

    Ranks differ from view to view, so a row has the ranks of ``WIDTH`` views side by side: an edge meets its source once
    for all of them, and sums are columns.
    """

    name, columns, parameters = "pr", ("v",), {"iterations": "int"}
    #: A third of a word.
    WIDTH = 21

    def run(self, data: ViewInput) -> Masked:
        if self.iterations < 0:
            raise InitError("pr property 'iterations' should be 0 or more")
        w, words = self.WIDTH, data.words
        each = min(w, len(data.views))
        cut = [F.struct(F.lit(c).alias("c"), F.shiftright(words[c * w // BITS], c * w % BITS).bitwiseAND(F.lit((1 << w) - 1).cast("bigint")).alias("has")) for c in range(-(-len(data.views) // w))]
        parts = data.rows().select("src", "dst", "n", F.explode(F.filter(F.array(*cut), lambda x: x["has"] != 0)).alias("x"))
        links = keep(parts.select("x.c", "src", "dst", "n", "x.has").repartition("c", "src"), "parts")
        has = lambda i: F.getbit("has", F.lit(i)) == 1
        degrees = links.groupBy("c", F.col("src").alias("v")).agg(*[F.sum(F.when(has(i), F.col("n"))).alias(f"d{i}") for i in range(each)])
        ends = links.select("c", F.explode(F.array("src", "dst")).alias("v"), "has").groupBy("c", "v").agg(F.bit_or("has").alias("has"))
        state = ends.join(degrees, ["c", "v"], "left").select("c", "v", "has", *[F.coalesce(f"d{i}", zero()).alias(f"d{i}") for i in range(each)], *[F.lit(6_000_000).cast("long").alias(f"r{i}") for i in range(each)])
        state, n = keep(state, "ranks"), 0
        while self.iterations == 0 or n < self.iterations:
            n += 1
            # a source gives the same to each of its edges
            shares = state.select("c", F.col("v").alias("src"), *[F.expr(f"CASE WHEN d{i} > 0 THEN (5 * r{i}) div (6 * d{i}) ELSE 0L END").alias(f"s{i}") for i in range(each)])
            pushed = links.join(shares, ["c", "src"]).groupBy("c", F.col("dst").alias("v")).agg(*[F.sum(F.when(has(i), F.col("n") * F.col(f"s{i}"))).alias(f"g{i}") for i in range(each)])
            met = state.join(pushed, ["c", "v"], "left")
            rank = lambda i: F.lit(1_000_000) + F.coalesce(f"g{i}", zero())
            moved = reduce(lambda a, b: a | b, [has(i) & (rank(i) != F.col(f"r{i}")) for i in range(each)])
            new = met.select("c", "v", "has", *[f"d{i}" for i in range(each)], *[rank(i).cast("long").alias(f"r{i}") for i in range(each)], moved.alias("moved"))
            before = state
            state, got = keep_measured(new, "ranks", moved=F.count_if("moved"))
            forget(before)
            if self.iterations == 0 and not got["moved"]:
                break
        ranks = F.array(*[F.when(has(i), F.col(f"r{i}")) for i in range(each)])
        distinct = state.select("c", "v", ranks.alias("ranks"), F.explode(F.array_distinct(F.array_compact(ranks))).alias("diff"))
        holds = F.aggregate(F.sequence(F.lit(0), F.lit(each - 1)), zero(), lambda m, i: m.bitwiseOR(F.when(F.get("ranks", i).eqNullSafe(F.col("diff")), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(zero())))
        marked = distinct.select("c", "v", "diff", holds.alias("m"))
        at = [F.when(F.floor(F.col("c") / (BITS // w)) == k, F.call_function("shiftleft", F.col("m"), (F.col("c") % (BITS // w) * w).cast("int"))).otherwise(zero()).alias(x) for k, x in enumerate(words)]
        return Masked(marked.select("v", "diff", *at), data.views)
