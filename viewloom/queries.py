"""The engine's queries over the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.engine import Engine
from viewloom.functions.predicates import filter_edges
from viewloom.graph import Graph
from viewloom.lang.parser import parse, parse_where
from viewloom.operators.algorithms import make
from viewloom.operators.collection import collection_matrix, make_collection
from viewloom.operators.results import accumulate
from viewloom.operators.summary import roll_up, summarise
from viewloom.plans import modes
from viewloom.sources.collections import generate_cube, window_cube
from viewloom.sources.tables import trade, transitions
from viewloom.queries_files import QUERIES as FILES

Query = Callable[[SparkSession, str], DataFrame]

# SQL of the two graphs
PLACES = "(nation JOIN region ON n_regionkey = r_regionkey)"
TRADE_V = f"""tv AS (
  SELECT c_custkey AS id, 'C' AS kind, c_mktsegment AS segment, n_name AS nation, r_name AS region FROM customer JOIN {PLACES} ON c_nationkey = n_nationkey
  UNION ALL SELECT 10000000 + s_suppkey, 'S', NULL, n_name, r_name FROM supplier JOIN {PLACES} ON s_nationkey = n_nationkey)"""
TRADE_E = """te AS (
  SELECT 10000000 + l_suppkey AS src, o_custkey AS dst, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(l_quantity AS BIGINT) AS qty, l_returnflag AS flag, l_linestatus AS status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
TRADE_J = """tj AS (SELECT te.*, u.kind AS ukind, u.segment AS usegment, u.nation AS unation, u.region AS uregion, v.kind AS vkind, v.segment AS vsegment, v.nation AS vnation, v.region AS vregion
  FROM te JOIN tv u ON u.id = te.src JOIN tv v ON v.id = te.dst)"""
TRANS_E = """xe AS (SELECT * FROM (
  SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, event_type, CAST(floor(value * 100) AS BIGINT) AS cents FROM events) WHERE dst IS NOT NULL)"""

YEARS = ["year <= 1996", "year <= 1998 and qty > 10", "year <= 2001 and u.region <> v.region and flag = 'R'"]
YEARS_SQL = ["year <= 1996", "year <= 1998 AND qty > 10", "year <= 2001 AND uregion <> vregion AND flag = 'R'"]
WALKS = ["cents >= 15000", "cents >= 17000 and u.id <> v.id", "event_type = 'purchase' and cents >= 12000"]
WALKS_SQL = ["cents >= 15000", "cents >= 17000 AND src <> dst", "event_type = 'purchase' AND cents >= 12000"]
ROOT = 89
GOALS = [(89, 8), (89, 110), (129, 41), (8, 2), (5, 5)]


def _walk_views(views: list[str] = WALKS_SQL) -> str:
    return "x AS (" + " UNION ALL ".join(f"SELECT {i} AS ts, src, dst FROM xe WHERE {w}" for i, w in enumerate(views)) + ")"


def _where(text: str) -> Query:
    """Edges a condition holds for, as a multiset."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return filter_edges(trade(spark, sf_dir), parse_where(text)).groupBy("src", "dst", "year", "qty", "flag", "status").agg(F.count("*").alias("n"))

    return query


def _where_sql(condition: str) -> str:
    return f"WITH {TRADE_V}, {TRADE_E}, {TRADE_J} SELECT src, dst, year, qty, flag, status, count(*) AS n FROM tj WHERE {condition} GROUP BY ALL"


#: name -> (condition, its SQL): an absent property makes a comparison false, and its negation true.
CONDITIONS = {
    "pred_edge_prop_lit": ("year <= 1997 and qty > 45", "year <= 1997 AND qty > 45"),
    "pred_edge_prop_prop": ("status < flag and qty >= 40", "status < flag AND qty >= 40"),
    "pred_src_lit": ("u.nation = 'NATION_3' and v.kind = 'C'", "unation = 'NATION_3' AND vkind = 'C'"),
    "pred_src_dst": ("u.region = v.region and qty >= 30", "uregion = vregion AND qty >= 30"),
    "pred_pair": ("e > (10000050, 700) and e <= (10000060, 20)", "(src > 10000050 OR (src = 10000050 AND dst > 700)) AND (src < 10000060 OR (src = 10000060 AND dst <= 20))"),
    "pred_neg_absent": ("!(u.segment <> 'BUILDING') and !(v.segment = 'BUILDING' and qty < 49) and qty > 40", "NOT coalesce(usegment <> 'BUILDING', false) AND NOT (coalesce(vsegment = 'BUILDING', false) AND qty < 49) AND qty > 40"),
    "pred_absent": ("u.segment <> 'BUILDING'", "usegment <> 'BUILDING'"),
    "pred_cross_type": ("qty < flag and flag <> e and year > 2000 and qty = 7", "year > 2000 AND qty = 7"),
    "pred_dst_id": ("v.id < 100 and u.id >= 10000090", "dst < 100 AND src >= 10000090"),
}


def vertices_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade(spark, sf_dir).vertices


def edges_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade(spark, sf_dir).edges.groupBy("src", "dst", "year", "qty", "flag", "status").agg(F.count("*").alias("n"))


def transition_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions(spark, sf_dir).edges.groupBy("src", "dst", "event_type", "cents").agg(F.count("*").alias("n"))


def _sections(text: str) -> dict:
    return parse(f"CREATE VIEW v WITH {text}").args


def _view(text: str, edges: bool) -> Query:
    """A summary's vertices, or its edges between the groups' texts."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        args = _sections(text)
        made = summarise(trade(spark, sf_dir), args["vertices"], args["edges"])
        return _shown(made, edges)

    return query


def _shown(made, edges: bool, *also: str) -> DataFrame:
    shown = made.vertices.withColumn("grp", F.concat_ws("|", "group"))
    if not edges:
        return shown.drop("group", "vid").withColumnRenamed("grp", "grp")
    u, v = shown.select(F.col("vid").alias("src"), F.col("grp").alias("src_grp"), *also), shown.select(F.col("vid").alias("dst"), F.col("grp").alias("dst_grp"), *also)
    return made.edges.join(u, ["src", *also]).join(v, ["dst", *also]).drop("src", "dst")


G_PROP = "VERTICES GROUP BY [(region, kind)] AGGREGATE {n: count(*), named: count(segment)} EDGES AGGREGATE {n: count(*), q: avg(qty)}"
G_FILTER = "VERTICES WHERE kind = 'C' and nation <> 'NATION_1' GROUP BY (segment) AGGREGATE {n: count(id)} EDGES WHERE qty > 25 AGGREGATE {n: count(*)}"
G_PLACES = "VERTICES WHERE region <> 'ASIA' GROUP BY (kind, region) AGGREGATE {n: count(id)} EDGES WHERE qty > 25 and u.region <> v.region AGGREGATE {n: count(*)}"
G_PRED = "VERTICES GROUP BY [([kind = 'S'][kind = 'C' and segment = 'BUILDING'], region = 'ASIA'), (nation, segment = 'MACHINERY')] AGGREGATE {n: count(*)} EDGES WHERE year >= 1999 AGGREGATE {n: count(*), q: avg(qty)}"
G_BETWEEN = "VERTICES AS S WHERE kind = 'S' GROUP BY (region) AGGREGATE {n: count(*)} VERTICES AS C WHERE kind = 'C' GROUP BY (segment) AGGREGATE {n: count(*)} VERTICES AS A GROUP BY (kind) EDGES BETWEEN (C, S) WHERE flag = 'A' AGGREGATE {n: count(*), q: avg(qty)} EDGES BETWEEN (A, A) AGGREGATE {n: count(*), q: avg(qty)}"


def _agg_cube(spark: SparkSession, sf_dir: str, edges: bool) -> DataFrame:
    args = _sections("VERTICES GROUP BY (region, kind, segment) AGGREGATE {n: count(*)} EDGES WHERE qty > 10 AGGREGATE {n: count(*), q: avg(qty)}")
    out = None
    for level, made in roll_up(trade(spark, sf_dir), args["vertices"], args["edges"]).items():
        shown = _shown(made, edges, "parts").withColumn("level", F.lit(level).cast("long")) if edges else _shown(made, False).withColumn("level", F.lit(level).cast("long"))
        out = shown if out is None else out.unionByName(shown)
    return out


def _cube_sql(edges: bool) -> str:
    parts = {"0": "'region=''' || coalesce({0}region, '') || ''''", "1": "'kind=''' || {0}kind || ''''", "2": "CASE WHEN {0}segment IS NULL THEN 'segment=''''' ELSE 'segment=''' || {0}segment || '''' END"}
    out = []
    for chosen in ("0,1,2", "0,1", "0,2", "1,2", "0", "1", "2"):
        grp = " || '|' || ".join(parts[p] for p in chosen.split(","))
        level = len(chosen.split(","))
        if edges:
            out.append(f"SELECT '{chosen}' AS parts, CAST({level} AS BIGINT) AS level, CAST(1 AS INT) AS section, {grp.format('u')} AS src_grp, {grp.format('v')} AS dst_grp, count(*) AS n, CAST(sum(qty) AS BIGINT) AS sum_q, count(qty) AS cnt_q FROM tj WHERE qty > 10 GROUP BY ALL")
        else:
            out.append(f"SELECT '{chosen}' AS parts, CAST({level} AS BIGINT) AS level, {grp.format('')} AS grp, count(*) AS n FROM tv GROUP BY ALL")
    return f"WITH {TRADE_V}, {TRADE_E}, {TRADE_J} " + " UNION ALL ".join(out)


def _years(spark: SparkSession, sf_dir: str):
    return make_collection(trade(spark, sf_dir), "years", [[parse_where(w) for w in YEARS]])


def collection_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _years(spark, sf_dir).view_edges().groupBy("ts", "src", "dst").agg(F.count("*").alias("n"))


def collection_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _years(spark, sf_dir).diffs().groupBy("ts", "src", "dst", "diff").agg(F.count("*").alias("n"))


def collection_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _years(spark, sf_dir).totals()


def collection_accumulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views from differences."""
    made = _years(spark, sf_dir)
    return accumulate(made.diffs().select("ts", "src", "dst", "diff"), made.timestamps).withColumnRenamed("diff", "n")


def cube_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of a product of two dimensions."""
    rows, cols = ["year <= 1996", "year <= 1998", "flag = 'R'"], ["qty > 30", "status = 'F'"]
    made = make_collection(trade(spark, sf_dir), "grid", [[parse_where(w) for w in rows], [parse_where(w) for w in cols]])
    return made.diffs().groupBy("ts", "src", "dst", "diff").agg(F.count("*").alias("n"))


def _cube_2d_sql() -> str:
    rows, cols = ["year <= 1996", "year <= 1998", "flag = 'R'"], ["qty > 30", "status = 'F'"]
    bit = lambda i, j: f"CAST(({rows[i]}) AND ({cols[j]}) AS INT)" if i >= 0 and j >= 0 else "0"
    parts = [f"SELECT {i * len(cols) + j} AS ts, src, dst, {bit(i, j)} - {bit(i - 1, j)} - {bit(i, j - 1)} + {bit(i - 1, j - 1)} AS diff FROM te" for i in range(len(rows)) for j in range(len(cols))]
    return f"WITH {TRADE_E}, d AS ({' UNION ALL '.join(parts)}) SELECT CAST(ts AS INT) AS ts, src, dst, CAST(diff AS BIGINT) AS diff, count(*) AS n FROM d WHERE diff <> 0 GROUP BY ALL"


MATRIX = ["qty > 10", "year <= 1998", "qty > 12 and flag <> 'A'", "year <= 1997 and status = 'F'", "qty > 11"]


def _matrix(spark: SparkSession, sf_dir: str):
    return collection_matrix(trade(spark, sf_dir), [parse_where(w) for w in MATRIX])


def distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, *_ = _matrix(spark, sf_dir)
    return spark.createDataFrame([(i, j, int(d[i, j])) for i in range(len(d)) for j in range(len(d))], "i int, j int, distance long")


def _matrix_sql() -> str:
    bits = ", ".join(["0 AS b0"] + [f"CAST({w} AS INT) AS b{i}" for i, w in enumerate(MATRIX, 1)])
    n = len(MATRIX) + 1
    parts = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, CAST(sum(CAST(b{i} <> b{j} AS INT)) AS BIGINT) AS distance FROM b" for i in range(n) for j in range(n))
    return f"WITH {TRADE_E}, b AS (SELECT {bits} FROM te) {parts}"


def collection_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The computed order of views, and the differences of that order and of the given one."""
    _, given, best, least = _matrix(spark, sf_dir)
    return spark.createDataFrame([(",".join(map(str, best)), given, least)], "best string, given_diffs long, best_diffs long")


def _walks(spark: SparkSession, sf_dir: str):
    return make_collection(transitions(spark, sf_dir), "walks", [[parse_where(w) for w in WALKS]])


def _algorithm(name: str, mode: str = "basic", diff: bool = False, adaptive: modes.Adaptive | None = None, splits: list[int] | None = None, **properties) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = modes.run(make(name, properties), _walks(spark, sf_dir), mode, adaptive, splits)
        return done.differences() if diff else done.full

    return query


def _reach(roots: str, limit: int = 60) -> str:
    """Recursive hops; r(ts, root, v, dist)."""
    return f"r(ts, root, v, dist) AS (SELECT t.ts, g.root, g.root, 0 FROM (VALUES (0), (1), (2)) t(ts), ({roots}) g(root) UNION SELECT r.ts, r.root, x.dst, r.dist + 1 FROM r JOIN x ON x.ts = r.ts AND x.src = r.v WHERE r.dist < {limit})"


_BFS = f"WITH RECURSIVE {TRANS_E}, {_walk_views()}, {_reach(f'SELECT {ROOT}', 30)}, f AS (SELECT ts, v, CAST(min(dist) AS BIGINT) AS dist FROM r GROUP BY ts, v)"
_WCC = f"WITH RECURSIVE {TRANS_E}, {_walk_views()}, y AS (SELECT ts, src, dst FROM x UNION SELECT ts, dst, src FROM x), c(ts, v, w) AS (SELECT ts, src, src FROM y UNION SELECT c.ts, c.v, y.dst FROM c JOIN y ON y.ts = c.ts AND y.src = c.w), f AS (SELECT ts, v, min(w) AS label FROM c GROUP BY ts, v)"
_SCC = f"WITH RECURSIVE {TRANS_E}, {_walk_views()}, c(ts, v, w) AS (SELECT ts, src, dst FROM x UNION SELECT c.ts, c.v, x.dst FROM c JOIN x ON x.ts = c.ts AND x.src = c.w)"
_DIFF = "g AS (SELECT ts, {0}, 1 AS diff FROM f UNION ALL SELECT ts + 1, {0}, -1 FROM f WHERE ts < 2) SELECT CAST(ts AS INT) AS ts, {0}, CAST(sum(diff) AS BIGINT) AS diff FROM g GROUP BY ALL HAVING sum(diff) <> 0"


def _pagerank_sql(n: int) -> str:
    rounds = ["r0 AS (SELECT ts, v, CAST(6000000 AS BIGINT) AS rank FROM vs)"]
    for k in range(n):
        rounds.append(f"r{k + 1} AS (SELECT vs.ts, vs.v, CAST(1000000 + coalesce(sum((5 * p.rank) // (6 * deg.n)), 0) AS BIGINT) AS rank FROM vs LEFT JOIN x ON x.ts = vs.ts AND x.dst = vs.v LEFT JOIN r{k} p ON p.ts = x.ts AND p.v = x.src LEFT JOIN deg ON deg.ts = x.ts AND deg.src = x.src GROUP BY vs.ts, vs.v)")
    return f"WITH {TRANS_E}, {_walk_views()}, vs AS (SELECT ts, src AS v FROM x UNION SELECT ts, dst FROM x), deg AS (SELECT ts, src, count(*) AS n FROM x GROUP BY ts, src), {', '.join(rounds)} SELECT CAST(ts AS INT) AS ts, v, rank AS diff FROM r{n}"


def _schedule_counts(kind: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        edges = transitions(spark, sf_dir).edges
        made = generate_cube("g", edges, 500, 40, 30, 5) if kind == "generate" else window_cube("w", edges, 400, 20, 60, 3, 2)
        rows = made.changes.groupBy("ts").agg(F.sum(F.when(F.col("diff") > 0, 1).otherwise(0)).alias("adds"), F.sum(F.when(F.col("diff") < 0, 1).otherwise(0)).alias("dels"))
        total = made.view_edges().groupBy("ts").agg(F.count("*").alias("edges"))
        return rows.join(total, "ts")

    return query


def _values(rows: list[tuple[int, int]]) -> str:
    out, here = [], 0
    for i, (a, d) in enumerate(rows):
        here += a - d
        out.append(f"(CAST({i} AS INT), CAST({a} AS BIGINT), CAST({d} AS BIGINT), CAST({here} AS BIGINT))")
    return f"SELECT * FROM (VALUES {', '.join(out)}) t(ts, adds, dels, edges)"


def language_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query language from text to results: a collection, then a computation on it."""
    engine = Engine(spark, transitions(spark, sf_dir))
    engine.script(f"CREATE VIEW COLLECTION walks WHERE {', '.join(f'[{w}]' for w in WALKS)} MANUALLY_ORDERED; RUN 2_STAGE_DIFFERENTIAL COMPUTATION wcc ON COLLECTION walks DIFFRESULTS;")
    return engine.last.differences()


#: Overlapping views: each drops a few edges of the one before.
MANY = 120


def many_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops in 120 views that have most edges in common: ts, reached, total of all distances."""
    views = [[parse_where(f"cents >= {14000 + 30 * i}") for i in range(MANY)]]
    done = modes.run(make("bfs", {"root": ROOT}), make_collection(transitions(spark, sf_dir), "many", views))
    return done.full.groupBy("ts").agg(F.count("*").alias("reached"), F.sum("dist").alias("total"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weakly connected components of three views of the trade graph: ts, components, largest."""
    graph: Graph = trade(spark, sf_dir)
    views = ["year <= 1996 and qty > 45", "year <= 1998 and qty > 47", "year <= 2001 and u.region <> v.region and qty = 50"]
    done = modes.run(make("wcc", {}), make_collection(graph, "years", [[parse_where(w) for w in views]]))
    sizes = done.full.groupBy("ts", "label").agg(F.count("*").alias("size"))
    return sizes.groupBy("ts").agg(F.count("*").alias("components"), F.max("size").alias("largest"))


QUERIES: dict[str, Query] = {
    "graph_trade_vertices": vertices_loaded,
    "graph_trade_edges": edges_loaded,
    "graph_transition_edges": transition_edges,
    **{name: _where(text) for name, (text, _) in CONDITIONS.items()},
    "view_filter": _view(G_FILTER, False),
    "view_filter_edges": _view(G_PLACES, True),
    "view_group_prop": _view(G_PROP, False),
    "view_edge_agg": _view(G_PROP, True),
    "view_group_predicate": _view(G_PRED, False),
    "view_multi_clause": _view(G_PRED, True),
    "view_between": _view(G_BETWEEN, True),
    "agg_cube_levels": lambda spark, sf_dir: _agg_cube(spark, sf_dir, False),
    "agg_cube_edges": lambda spark, sf_dir: _agg_cube(spark, sf_dir, True),
    "collection_full": collection_full,
    "collection_diff": collection_diff,
    "collection_totals": collection_totals,
    "collection_matrix": distance_matrix,
    "collection_order": collection_order,
    "cube_accumulate": collection_accumulated,
    "cube_2d_diff": cube_2d,
    "bfs_full": _algorithm("bfs", root=ROOT),
    "bfs_diff": _algorithm("bfs", diff=True, root=ROOT),
    "sssp_full": _algorithm("sssp", root=ROOT, weight_cap=7),
    "wcc_full": _algorithm("wcc"),
    "wcc_diff": _algorithm("wcc", diff=True),
    "scc_full": _algorithm("scc"),
    "mpsp_full": _algorithm("mpsp", goals=GOALS),
    "pagerank_full": _algorithm("pr", iterations=4),
    "mode_individual_wcc": _algorithm("wcc", "individual"),
    "mode_compare_wcc": _algorithm("wcc", "compare_differential"),
    "mode_adaptive_bfs": _algorithm("bfs", "adaptive", adaptive=modes.Adaptive(5, 1.5, 1.0, 5, "avg"), root=ROOT),
    "mode_split_wcc_diff": _algorithm("wcc", "adaptive", diff=True, splits=[1]),
    "mode_one_stage_pagerank": _algorithm("pr", "1_stage_differential", iterations=2),
    "mode_basic_individual_pagerank": _algorithm("pr", "basic_individual", iterations=2),
    "mode_default_pagerank": _algorithm("pr", None, iterations=2),
    "mode_adaptive_lr_pagerank": _algorithm("pr", "adaptive", adaptive=modes.Adaptive(1, 1.3, 1.0, 10, "lr"), iterations=2),
    "many_views_bfs": many_views,
    "generate_counts": _schedule_counts("generate"),
    "window_counts": _schedule_counts("window"),
    "language_script": language_script,
    **FILES,
}


def _group_sql(prefix: str, name: str) -> str:
    return f"CASE WHEN {prefix}{name} IS NULL THEN '{name}=''''' ELSE '{name}=''' || {prefix}{name} || '''' END"


_HEAD = f"WITH {TRADE_V}, {TRADE_E}, {TRADE_J}"
_PRED_GROUPS = """(
  SELECT id, 'kind = ''S''|region = ''ASIA''' AS g FROM tv WHERE kind = 'S' AND region = 'ASIA'
  UNION ALL SELECT id, 'kind = ''C'' and segment = ''BUILDING''|region = ''ASIA''' FROM tv WHERE kind = 'C' AND segment = 'BUILDING' AND region = 'ASIA'
  UNION ALL SELECT id, 'nation=''' || nation || '''|segment = ''MACHINERY''' FROM tv WHERE segment = 'MACHINERY')"""

SQL: dict[str, str] = {
    "graph_trade_vertices": f"WITH {TRADE_V} SELECT id, kind, segment, nation, region FROM tv",
    "graph_trade_edges": f"WITH {TRADE_E} SELECT src, dst, year, qty, flag, status, count(*) AS n FROM te GROUP BY ALL",
    "graph_transition_edges": f"WITH {TRANS_E} SELECT src, dst, event_type, cents, count(*) AS n FROM xe GROUP BY ALL",
    **{name: _where_sql(sql) for name, (_, sql) in CONDITIONS.items()},
    "view_filter": f"{_HEAD} SELECT CAST(1 AS INT) AS section, {_group_sql('', 'segment')} AS grp, count(*) AS n FROM tv WHERE kind = 'C' AND nation <> 'NATION_1' GROUP BY ALL",
    "view_filter_edges": f"{_HEAD} SELECT CAST(1 AS INT) AS section, {_group_sql('u', 'kind')} || '|' || {_group_sql('u', 'region')} AS src_grp, {_group_sql('v', 'kind')} || '|' || {_group_sql('v', 'region')} AS dst_grp, count(*) AS n FROM tj WHERE qty > 25 AND uregion <> vregion AND uregion <> 'ASIA' AND vregion <> 'ASIA' GROUP BY ALL",
    "view_group_prop": f"{_HEAD} SELECT CAST(1 AS INT) AS section, {_group_sql('', 'region')} || '|' || {_group_sql('', 'kind')} AS grp, count(*) AS n, count(segment) AS named FROM tv GROUP BY ALL",
    "view_edge_agg": f"{_HEAD} SELECT CAST(1 AS INT) AS section, {_group_sql('u', 'region')} || '|' || {_group_sql('u', 'kind')} AS src_grp, {_group_sql('v', 'region')} || '|' || {_group_sql('v', 'kind')} AS dst_grp, count(*) AS n, CAST(sum(qty) AS BIGINT) AS sum_q, count(qty) AS cnt_q FROM tj GROUP BY ALL",
    "view_group_predicate": f"{_HEAD} SELECT CAST(1 AS INT) AS section, g AS grp, count(*) AS n FROM {_PRED_GROUPS} GROUP BY ALL",
    "view_multi_clause": f"{_HEAD}, m AS {_PRED_GROUPS} SELECT CAST(1 AS INT) AS section, a.g AS src_grp, b.g AS dst_grp, count(*) AS n, CAST(sum(qty) AS BIGINT) AS sum_q, count(qty) AS cnt_q FROM te JOIN m a ON a.id = src JOIN m b ON b.id = dst WHERE year >= 1999 GROUP BY ALL",
    "view_between": f"""{_HEAD}
SELECT CAST(1 AS INT) AS section, {_group_sql('u', 'region')} AS src_grp, {_group_sql('v', 'segment')} AS dst_grp, count(*) AS n, CAST(sum(qty) AS BIGINT) AS sum_q, count(qty) AS cnt_q FROM tj WHERE flag = 'A' AND ukind = 'S' AND vkind = 'C' GROUP BY ALL
UNION ALL SELECT CAST(2 AS INT), {_group_sql('u', 'kind')}, {_group_sql('v', 'kind')}, count(*), CAST(sum(qty) AS BIGINT), count(qty) FROM tj GROUP BY ALL""",
    "agg_cube_levels": _cube_sql(False),
    "agg_cube_edges": _cube_sql(True),
    "collection_full": f"{_HEAD} " + " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS ts, src, dst, count(*) AS n FROM tj WHERE {w} GROUP BY ALL" for i, w in enumerate(YEARS_SQL)),
    "collection_diff": f"{_HEAD}, d AS (" + " UNION ALL ".join(f"SELECT {i} AS ts, src, dst, CAST({w} AS INT) - {f'CAST({YEARS_SQL[i - 1]} AS INT)' if i else '0'} AS diff FROM tj" for i, w in enumerate(YEARS_SQL)) + ") SELECT CAST(ts AS INT) AS ts, src, dst, CAST(diff AS BIGINT) AS diff, count(*) AS n FROM d WHERE diff <> 0 GROUP BY ALL",
    "collection_totals": f"{_HEAD} " + " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS ts, CAST(sum(CAST(({w}) AND NOT ({YEARS_SQL[i - 1] if i else 'false'}) AS INT)) AS BIGINT) AS adds, CAST(sum(CAST(NOT ({w}) AND ({YEARS_SQL[i - 1] if i else 'false'}) AS INT)) AS BIGINT) AS dels, CAST(sum(CAST({w} AS INT)) AS BIGINT) AS edges FROM tj" for i, w in enumerate(YEARS_SQL)),
    "collection_matrix": _matrix_sql(),
    "cube_accumulate": f"{_HEAD} " + " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS ts, src, dst, count(*) AS n FROM tj WHERE {w} GROUP BY ALL" for i, w in enumerate(YEARS_SQL)),
    "cube_2d_diff": _cube_2d_sql(),
    "bfs_full": f"{_BFS} SELECT CAST(ts AS INT) AS ts, v, dist, CAST(1 AS BIGINT) AS diff FROM f",
    "bfs_diff": f"{_BFS}, {_DIFF.format('v, dist')}",
    "sssp_full": f"WITH RECURSIVE {TRANS_E}, {_walk_views()}, r(ts, v, dist) AS (SELECT t.ts, {ROOT}, 0 FROM (VALUES (0), (1), (2)) t(ts) UNION SELECT r.ts, x.dst, r.dist + (x.src + x.dst) % 7 + 1 FROM r JOIN x ON x.ts = r.ts AND x.src = r.v WHERE r.dist < 80) SELECT CAST(ts AS INT) AS ts, v, CAST(min(dist) AS BIGINT) AS dist, CAST(1 AS BIGINT) AS diff FROM r GROUP BY ts, v",
    "wcc_full": f"{_WCC} SELECT CAST(ts AS INT) AS ts, v, label, CAST(1 AS BIGINT) AS diff FROM f",
    "wcc_diff": f"{_WCC}, {_DIFF.format('v, label')}",
    "scc_full": f"{_SCC} SELECT CAST(x.ts AS INT) AS ts, x.src, x.dst, count(*) AS diff FROM x WHERE EXISTS (SELECT 1 FROM c WHERE c.ts = x.ts AND c.v = x.dst AND c.w = x.src) GROUP BY ALL",
    "mpsp_full": f"WITH RECURSIVE {TRANS_E}, {_walk_views()}, {_reach('SELECT DISTINCT s FROM (VALUES ' + ', '.join(map(str, GOALS)) + ') g(s, d)', 30)} SELECT CAST(ts AS INT) AS ts, root AS src, v AS dst, CAST(min(dist) AS BIGINT) AS len, CAST(1 AS BIGINT) AS diff FROM r JOIN (VALUES {', '.join(map(str, GOALS))}) g(s, d) ON g.s = root AND g.d = v GROUP BY ALL",
    "pagerank_full": _pagerank_sql(4),
    "mode_individual_wcc": f"{_WCC} SELECT CAST(ts AS INT) AS ts, v, label, CAST(1 AS BIGINT) AS diff FROM f",
    "mode_compare_wcc": f"{_WCC} SELECT CAST(ts AS INT) AS ts, v, label, CAST(1 AS BIGINT) AS diff FROM f",
    "mode_adaptive_bfs": f"{_BFS} SELECT CAST(ts AS INT) AS ts, v, dist, CAST(1 AS BIGINT) AS diff FROM f",
    "mode_split_wcc_diff": f"{_WCC}, g AS (SELECT ts, v, label, 1 AS diff FROM f UNION ALL SELECT ts + 1, v, label, -1 FROM f WHERE ts = 1) SELECT CAST(ts AS INT) AS ts, v, label, CAST(sum(diff) AS BIGINT) AS diff FROM g GROUP BY ALL HAVING sum(diff) <> 0",
    **{name: _pagerank_sql(2) for name in ("mode_one_stage_pagerank", "mode_basic_individual_pagerank", "mode_default_pagerank", "mode_adaptive_lr_pagerank")},
    "many_views_bfs": f"""WITH RECURSIVE {TRANS_E}, n AS (SELECT CAST(unnest(range({MANY})) AS INT) AS ts), x AS (SELECT DISTINCT ts, src, dst FROM xe JOIN n ON cents >= 14000 + 30 * ts),
r(ts, v, dist) AS (SELECT ts, CAST({ROOT} AS BIGINT), 0 FROM n UNION SELECT r.ts, x.dst, r.dist + 1 FROM r JOIN x ON x.ts = r.ts AND x.src = r.v WHERE r.dist < 40),
f AS (SELECT ts, v, min(dist) AS dist FROM r GROUP BY ts, v) SELECT ts, count(*) AS reached, CAST(sum(dist) AS BIGINT) AS total FROM f GROUP BY ts""",
    "generate_counts": _values([(500, 0)] + [(40, 30)] * 5),
    "window_counts": _values([(400, 0), (10, 10), (10, 10), (30, 30), (10, 10), (10, 10)]),
    "language_script": f"{_WCC}, {_DIFF.format('v, label')}",
}

_FULL, _CHANGES = SQL["collection_full"], SQL["collection_diff"]
SQL |= {
    "csv_load_vertices": SQL["graph_trade_vertices"],
    "csv_load_edges": SQL["graph_trade_edges"],
    "csv_load_dialect": f"WITH {TRANS_E} SELECT src, dst, count(*) AS n FROM xe GROUP BY ALL",
    "csv_randomized_ids": f"WITH {TRADE_V}, {TRADE_E}, c AS (SELECT 'vertices' AS what, count(*) AS n FROM tv UNION ALL SELECT 'edges', count(*) FROM te) SELECT what, n, n AS ids, CAST(0 AS BIGINT) AS least, n - 1 AS greatest FROM c",
    "csv_mappings": f"WITH {TRADE_V} SELECT id, true AS same FROM tv",
    "save_graph_edges": f"WITH {TRADE_E} SELECT src, dst, count(*) AS n FROM te GROUP BY ALL",
    "serialize_store": SQL["collection_totals"],
    "serialize_cube": _CHANGES,
    "save_cube_full": _FULL,
    "save_cube_diff": _CHANGES,
    "load_cube": _FULL,
    "save_results": SQL["wcc_full"],
}
