"""Collections from and to files, and made at random from a graph."""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.errors import CollectionError, SerdeError
from viewloom.graph import Graph
from viewloom.operators.collection import Collection, DiffCollection, MaskCollection
from viewloom.operators.timestamps import Timestamps
from viewloom.sources.graph_csv import dense_ids
from viewloom.sources.shared import keep


def load_cube(spark: SparkSession, name: str, lengths: Sequence[int], path: str, prefix: str, separator: str = ",", comment: str | None = None, with_full: bool = False) -> DiffCollection:
    """A collection from files ``{prefix}0_{j}.txt`` (``{prefix}{i}_{j}.txt`` for two dimensions) of ``u,v,diff``; rows of no difference are dropped.

    with_full: check that every view is a graph without repeated or missing edges.
    """
    stamps = Timestamps(tuple(lengths))
    parts = []
    for i, ts in enumerate(stamps.all):
        reader = spark.read.schema("u string, v string, d string").option("sep", separator).option("mode", "PERMISSIVE")
        if comment:
            reader = reader.option("comment", comment)
        file = "_".join(map(str, ts if len(ts) > 1 else (0, *ts)))
        parts.append(reader.csv(f"{path}/{prefix}{file}.txt").select(F.lit(i).alias("ts"), "u", "v", "d"))
    rows = reduce(DataFrame.unionByName, parts)
    number = lambda c: F.coalesce(F.trim(F.col(c)).try_cast("bigint"), F.raise_error(F.concat(F.lit("[CollectionError] bad number '"), F.coalesce(F.col(c), F.lit("")), F.lit("'"))).cast("bigint"))
    made = rows.select("ts", number("u").alias("src"), number("v").alias("dst"), number("d").alias("diff")).filter("diff <> 0")
    out = DiffCollection(name, stamps, [stamps.text(i) for i in range(len(stamps))], keep(made, "cube"))
    if with_full:
        wrong = out.view_edges().groupBy("ts", "src", "dst").count().filter("count > 1").first()
        if wrong:
            raise CollectionError(f"edge ({wrong['src']}, {wrong['dst']}) is {wrong['count']} times in view {wrong['ts']}")
    return out


def _schedule(name: str, edges: DataFrame, steps: list[tuple[int, int]], seed: int) -> DiffCollection:
    """steps: (adds, dels) of each view; it adds the next edges of a random order and deletes some that views before added."""
    need, here = sum(a for a, _ in steps), 0
    total = edges.count()
    for adds, dels in steps:
        if dels > here:
            raise CollectionError("edges exhausted for deletion")
        here += adds - dels
    if need > total:
        raise CollectionError(f"edges exhausted for addition: {need} are needed, {total} are there")
    spark = edges.sparkSession
    placed = dense_ids(edges.select("src", "dst", F.rand(seed).alias("__r")).orderBy("__r").select("src", "dst"), "place").filter(F.col("place") < need)
    # a place's view is found by a search in the sorted bounds, in each row by itself
    adding = [i for i, (a, _) in enumerate(steps) if a]
    bounds = [0.0, *[float(end) for i, end in enumerate(itertools.accumulate(a for a, _ in steps)) if steps[i][0]]]
    if adding:
        dealt = Bucketizer(splits=bounds, inputCol="__at", outputCol="__nth").transform(placed.withColumn("__at", F.col("place").cast("double")))
        view = F.get(F.array(*[F.lit(i) for i in adding]), F.col("__nth").cast("int"))
    else:
        dealt, view = placed, F.lit(0)
    added = keep(dealt.select(view.alias("ts"), "src", "dst", "place"), "added")
    deleted = spark.createDataFrame(list(_deletions(steps, seed)), "ts int, place long")
    gone = deleted.join(added.select("place", "src", "dst"), "place").select("ts", "src", "dst", F.lit(-1).cast("long").alias("diff"))
    changes = added.select("ts", "src", "dst", F.lit(1).cast("long").alias("diff")).unionByName(gone)
    return DiffCollection(name, Timestamps((len(steps),)), [str(i) for i in range(len(steps))], keep(changes, "cube"))


def _deletions(steps: list[tuple[int, int]], seed: int) -> Iterator[tuple[int, int]]:
    """(view, place) of each deletion: a uniform choice among the edges that views before added and none deleted.

    Places are drawn again if their edge is gone, so only deletions are held, not edges.
    """
    rng = random.Random(seed)
    gone: set[int] = set()
    there = 0
    for i, (adds, dels) in enumerate(steps):
        for _ in range(dels):
            place = rng.randrange(there)
            while place in gone:
                place = rng.randrange(there)
            gone.add(place)
            yield i, place
        there += adds


def generate_cube(name: str, edges: DataFrame, first: int, adds: int, dels: int, batches: int, seed: int = 0) -> DiffCollection:
    """View 0 has ``first`` random edges; each of ``batches`` views adds ``adds`` more and deletes ``dels`` of the earlier ones."""
    steps = [(first, 0), *[(adds, dels)] * batches]
    return _schedule(name, edges, steps, seed)


def window_cube(name: str, edges: DataFrame, first: int, small: int, large: int, diffs: int, total: int, seed: int = 0) -> DiffCollection:
    """``total`` batches of ``diffs`` views over a random order of the edges: a batch's first view adds and deletes large/2
    edges, the others small/2; the very first has ``first`` edges."""
    steps = [(large // 2, large // 2) if j == 0 else (small // 2, small // 2) for _ in range(total) for j in range(diffs)]
    steps[:1] = [(first, 0)] if steps else []
    return _schedule(name, edges, steps, seed)


def save_cube(collection: Collection, path: str, bare_first: bool = False) -> None:
    """Per view ``fcube-{name}-full-{ts}.txt`` (``s,d``) and ``fcube-{name}-diff-{ts}.txt`` (``s d +1``; without the number in the first view if ``bare_first``)."""
    full, diffs = keep(collection.view_edges(), "full"), keep(collection.diffs(), "diffs")
    for i in range(len(collection.timestamps)):
        ts = collection.timestamps.text(i, "_")
        full.filter(F.col("ts") == i).select(F.concat_ws(",", "src", "dst").alias("value")).write.mode("overwrite").text(f"{path}/fcube-{collection.name}-full-{ts}.txt")
        ends = [F.col("src").cast("string"), F.col("dst").cast("string")]
        number = [] if bare_first and i == 0 else [F.format_string("%+d", F.col("diff"))]
        diffs.filter(F.col("ts") == i).select(F.concat_ws(" ", *ends, *number).alias("value")).write.mode("overwrite").text(f"{path}/fcube-{collection.name}-diff-{ts}.txt")


def save_results(outcome, path: str, columns: Sequence[str]) -> None:
    """Per view ``results-full-{ts}.txt`` and ``results-diff-{ts}.txt``, lines ``(v, d), +1``."""
    full, diffs = keep(outcome.full, "full"), keep(outcome.differences(), "diffs")
    shown = F.concat(F.lit("("), F.concat_ws(", ", *[F.col(c).cast("string") for c in columns]), F.lit("), ")) if len(columns) > 1 else F.concat(F.col(columns[0]).cast("string"), F.lit(", "))
    for i in range(len(outcome.collection.timestamps)):
        for kind, df in (("full", full), ("diff", diffs)):
            lines = df.filter(F.col("ts") == i).select(F.concat(shown, F.format_string("%+d", F.col("diff"))).alias("value"))
            lines.write.mode("overwrite").text(f"{path}/results-{kind}-{outcome.collection.timestamps.text(i, '_')}.txt")


def _write_json(spark: SparkSession, path: str, value: object) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_json(spark: SparkSession, path: str):
    try:
        return json.loads(spark.read.text(path).first()["value"])
    except Exception as e:
        raise SerdeError(f"Invalid directory: '{path}'") from e


def write_collection(spark: SparkSession, collection: Collection, path: str) -> None:
    """Parquet, and a manifest."""
    masks = isinstance(collection, MaskCollection)
    (collection.edges if masks else collection.changes).write.mode("overwrite").parquet(f"{path}/data")
    extra = {"words": collection.words, "places": collection.places} if masks else {}
    _write_json(spark, f"{path}/manifest", {"name": collection.name, "lengths": collection.timestamps.lengths, "texts": collection.texts, "masks": masks} | extra)


def read_collection(spark: SparkSession, path: str) -> Collection:
    m = _read_json(spark, f"{path}/manifest")
    data, stamps = spark.read.parquet(f"{path}/data"), Timestamps(tuple(m["lengths"]))
    if m["masks"]:
        return MaskCollection(m["name"], stamps, m["texts"], data, m["words"], m["places"])
    return DiffCollection(m["name"], stamps, m["texts"], data)


def write_store(spark: SparkSession, graph: Graph | None, collections: dict[str, Collection], path: str) -> None:
    """Graph and collections, with a manifest."""
    if graph:
        graph.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
        graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
    for i, c in enumerate(collections.values()):
        write_collection(spark, c, f"{path}/collection-{i}")
    _write_json(spark, f"{path}/manifest", {"graph": bool(graph), "collections": len(collections)})


def read_store(spark: SparkSession, path: str) -> tuple[Graph | None, dict[str, Collection]]:
    m = _read_json(spark, f"{path}/manifest")
    graph = Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")) if m["graph"] else None
    found = [read_collection(spark, f"{path}/collection-{i}") for i in range(m["collections"])]
    return graph, {c.name: c for c in found}
