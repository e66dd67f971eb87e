"""Queries over sources and sinks: the test tables as files, loaded, saved and read back by statements, and the same in SQL.

Files are written with Spark into the shared folder, so that all executors read them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.engine import Engine
from viewloom.graph import Graph
from viewloom.operators.collection import make_collection
from viewloom.operators.results import accumulate
from viewloom.sources.shared import shared_folder
from viewloom.sources.tables import trade, transitions

Query = Callable[[SparkSession, str], DataFrame]

PROPERTIES = ("year:int", "qty:int", "flag", "status")


def _trade_files(spark: SparkSession, sf_dir: str) -> str:
    """The trade graph as CSV: v.csv and e.csv with typed headers."""
    graph, folder = trade(spark, sf_dir), shared_folder(spark, "csv")
    graph.vertices.select(F.col("id").alias(":id"), "kind", "segment", F.col("nation").alias("nation:string"), "region").write.option("header", True).csv(f"{folder}/v.csv")
    graph.edges.select(F.col("src").alias("from:start_id"), F.col("dst").alias("to:end_id"), *[F.col(p.partition(":")[0]).alias(p) for p in PROPERTIES]).write.option("header", True).csv(f"{folder}/e.csv")
    return folder


def _loaded(spark: SparkSession, sf_dir: str, options: str = "") -> tuple[Engine, str]:
    folder = _trade_files(spark, sf_dir)
    engine = Engine(spark, seed=7)
    engine.execute(f"LOAD GRAPH WITH VERTICES FROM '{folder}/v.csv' AND EDGES FROM '{folder}/e.csv' {options.format(folder=folder)}")
    return engine, folder


def _by_own_ids(graph: Graph, edges: DataFrame, *also: str) -> DataFrame:
    """Edges with the ids that their file gave, counted."""
    own = graph.vertices.select(F.col("id").alias("at"), F.col("ext_id").cast("long").alias("ext"))
    u, v = own.select(F.col("at").alias("src"), F.col("ext").alias("from")), own.select(F.col("at").alias("dst"), F.col("ext").alias("to"))
    named = edges.join(u, "src").join(v, "dst").select(F.col("from").alias("src"), F.col("to").alias("dst"), *also)
    return named.groupBy("src", "dst", *also).agg(F.count("*").alias("n"))


def csv_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, _ = _loaded(spark, sf_dir)
    return engine.graph.vertices.select(F.col("ext_id").cast("long").alias("id"), "kind", "segment", "nation", "region")


def csv_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, _ = _loaded(spark, sf_dir)
    return _by_own_ids(engine.graph, engine.graph.edges, "year", "qty", "flag", "status")


def _dense(df: DataFrame, what: str) -> DataFrame:
    return df.agg(F.lit(what).alias("what"), F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min("id").alias("least"), F.max("id").alias("greatest"))


def csv_randomized_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices and edges are numbered without gaps, edges in a random order."""
    engine, _ = _loaded(spark, sf_dir, "RANDOMIZE")
    return _dense(engine.graph.vertices, "vertices").unionByName(_dense(engine.graph.edges, "edges"))


def csv_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saved mapping says of each vertex the number that the graph has."""
    engine, folder = _loaded(spark, sf_dir, "SAVE MAPPINGS TO '{folder}/mappings'")
    cells = F.split("value", ",")
    saved = spark.read.text(f"{folder}/mappings/vertex_mappings.txt").select(cells[0].alias("ext_id"), cells[1].cast("long").alias("saved"))
    return engine.graph.vertices.join(saved, "ext_id").select(F.col("ext_id").cast("long").alias("id"), (F.col("id") == F.col("saved")).alias("same"))


def csv_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars between cells, comments, and neither headers nor a vertex file."""
    folder = shared_folder(spark, "csv")
    lines = transitions(spark, sf_dir).edges.select(F.explode(F.array(F.concat_ws("|", "src", "dst"), F.lit("# a comment"))).alias("value"))
    lines.write.text(f"{folder}/e.csv")
    engine = Engine(spark)
    engine.execute(f"LOAD GRAPH WITH EDGES FROM '{folder}/e.csv' SEPARATOR '|' COMMENT '#' HAS_HEADERS false")
    return _by_own_ids(engine.graph, engine.graph.edges)


def saved_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, folder = _loaded(spark, sf_dir)
    engine.execute(f"SAVE GRAPH TO '{folder}/saved'")
    cells = F.split("value", ",")
    return _by_own_ids(engine.graph, spark.read.text(f"{folder}/saved/edges.txt").select(cells[0].cast("long").alias("src"), cells[1].cast("long").alias("dst")))


YEARS = "[year <= 1996],[year <= 1998 and qty > 10],[year <= 2001 and u.region <> v.region and flag = 'R']"


def _with_years(spark: SparkSession, sf_dir: str) -> tuple[Engine, str]:
    engine, folder = Engine(spark, trade(spark, sf_dir)), shared_folder(spark, "files")
    engine.execute(f"CREATE VIEW COLLECTION years WHERE {YEARS} MANUALLY_ORDERED")
    return engine, folder


def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph and collections, serialized, and read by another engine."""
    engine, folder = _with_years(spark, sf_dir)
    engine.execute(f"SERIALIZE TO '{folder}/store'")
    other = Engine(spark)
    other.execute(f"DESERIALIZE FROM '{folder}/store'")
    return other.collection("years").totals()


def cube_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, folder = _with_years(spark, sf_dir)
    engine.execute(f"SERIALIZE CUBE years TO '{folder}/cube'")
    engine.execute("DELETE CUBES")
    engine.execute(f"DESERIALIZE CUBE FROM '{folder}/cube'")
    return engine.collection("years").diffs().groupBy("ts", "src", "dst", "diff").agg(F.count("*").alias("n"))


def _saved_views(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """ts and value of the lines of per-view text folders."""
    out = None
    for ts in range(3):
        lines = spark.read.text(f"{path}/{pattern.format(ts)}").select(F.lit(ts).alias("ts"), "value")
        out = lines if out is None else out.unionByName(lines)
    return out


def saved_cube_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, folder = _with_years(spark, sf_dir)
    engine.execute(f"SAVE CUBE years TO '{folder}/cube' 2 false")
    cells = F.split("value", ",")
    lines = _saved_views(spark, f"{folder}/cube", "fcube-years-full-{}.txt")
    return lines.groupBy("ts", cells[0].cast("long").alias("src"), cells[1].cast("long").alias("dst")).agg(F.count("*").alias("n"))


def saved_cube_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, folder = _with_years(spark, sf_dir)
    engine.execute(f"SAVE CUBE years TO '{folder}/cube' 2 false")
    cells = F.split("value", " ")
    lines = _saved_views(spark, f"{folder}/cube", "fcube-years-diff-{}.txt")
    return lines.groupBy("ts", cells[0].cast("long").alias("src"), cells[1].cast("long").alias("dst"), cells[2].cast("long").alias("diff")).agg(F.count("*").alias("n"))


def loaded_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of signed edges, a file for each view, and the views that they add up to."""
    made = make_collection(*_graph_and_years(spark, sf_dir))
    folder = shared_folder(spark, "cube")
    for ts in range(3):
        made.diffs().filter(F.col("ts") == ts).select(F.concat_ws(",", "src", "dst", "diff").alias("value")).write.text(f"{folder}/batch-0_{ts}.txt")
    engine = Engine(spark)
    engine.execute(f"LOAD CUBE years 1 3 FROM '{folder}' WITH PREFIX 'batch-'")
    found = engine.collection("years")
    return accumulate(found.diffs().select("ts", "src", "dst", "diff"), found.timestamps).withColumnRenamed("diff", "n")


def _graph_and_years(spark: SparkSession, sf_dir: str):
    from viewloom.lang.parser import parse

    return trade(spark, sf_dir), "years", [parse(f"CREATE VIEW COLLECTION y WHERE {YEARS}").args["views"]]


WALKS = "[cents >= 15000],[cents >= 17000 and u.id <> v.id],[event_type = 'purchase' and cents >= 12000]"


def saved_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A computation's whole results, written by view and read back."""
    engine, folder = Engine(spark, transitions(spark, sf_dir)), shared_folder(spark, "results")
    engine.script(f"CREATE VIEW COLLECTION walks WHERE {WALKS} MANUALLY_ORDERED; RUN 1_STAGE_DIFFERENTIAL COMPUTATION wcc ON COLLECTION walks SAVE RESULTS TO '{folder}/wcc'")
    cells = lambda i: F.regexp_extract("value", r"^\((-?\d+), (-?\d+)\), ([+-]\d+)$", i).cast("long")
    return _saved_views(spark, f"{folder}/wcc", "results-full-{}.txt").select("ts", cells(1).alias("v"), cells(2).alias("label"), cells(3).alias("diff"))


QUERIES: dict[str, Query] = {
    "csv_load_vertices": csv_vertices,
    "csv_load_edges": csv_edges,
    "csv_load_dialect": csv_dialect,
    "csv_randomized_ids": csv_randomized_ids,
    "csv_mappings": csv_mappings,
    "save_graph_edges": saved_graph,
    "serialize_store": store_round_trip,
    "serialize_cube": cube_store,
    "save_cube_full": saved_cube_full,
    "save_cube_diff": saved_cube_diff,
    "load_cube": loaded_cube,
    "save_results": saved_results,
}
