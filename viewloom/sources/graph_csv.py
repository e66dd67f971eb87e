"""Graphs from CSV files: typed headers, dense ids in file order, absent values for empty cells.

The first column of vertices is their id (a header with ``:`` must say ``:id``), the first two of edges are the ends
(``:start_id``, ``:end_id``). Further headers are ``name[:type]`` with type int, bool or string. Without headers only ids
are read. Rows with a wrong number of cells are dropped.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewloom.errors import LoadGraphError
from viewloom.graph import Graph
from viewloom.sources.shared import keep

TYPES = {"int": "bigint", "bool": "boolean", "string": "string"}


def dense_ids(df: DataFrame, name: str) -> DataFrame:
    """Number the rows from 0 in their order: by partition, then by place in it. Only a row per partition is on the driver."""
    placed = keep(df.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}), "numbered")
    parts = placed.groupBy("__part").agg(F.count("*").alias("n"), F.min("__row").alias("first")).orderBy("__part").collect()
    before = itertools.accumulate([0, *[p["n"] for p in parts]])
    moves = df.sparkSession.createDataFrame([(p["__part"], b - p["first"]) for p, b in zip(parts, before)], "__part int, __move long")
    # rows of a partition are numbered without gaps, as nothing was dropped after numbering
    return placed.join(F.broadcast(moves), "__part").withColumn(name, F.col("__row") + F.col("__move")).drop("__part", "__row", "__move")


def _header(spark: SparkSession, path: str, separator: str, comment: str | None) -> list[str]:
    lines = spark.read.text(path).filter(F.trim("value") != "")
    if comment:
        lines = lines.filter(~F.col("value").startswith(comment))
    first = lines.first()
    if first is None:
        raise LoadGraphError(f"'{path}' is empty")
    return [c.strip().strip('"') for c in first["value"].split(separator)]


def read_rows(spark: SparkSession, path: str, columns: int, separator: str, comment: str | None, header: bool) -> DataFrame:
    """c0, c1, ...: the cells as text, in file order, ragged rows dropped."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(columns)])
    reader = spark.read.schema(schema).option("sep", separator).option("header", header).option("mode", "DROPMALFORMED").option("columnPruning", False).option("escape", "").option("enforceSchema", True)
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(path)


def _typed(name: str, kind: str, cell: Column) -> Column:
    if kind == "int":
        good, value = cell.rlike(r"^[+-]?[0-9]+$"), cell.try_cast("bigint")
    elif kind == "bool":
        good, value = cell.isin("true", "false"), cell == "true"
    else:
        return cell
    wrong = F.raise_error(F.concat(F.lit("[LoadGraphError] Could not parse property value '"), cell, F.lit(f"' of '{name}' as {kind}")))
    return F.when(cell.isNull(), None).when(good & value.isNotNull(), value).otherwise(wrong.cast(TYPES[kind]))


def _schema(headers: list[str], ids: list[str], path: str) -> list[tuple[str, str]]:
    for h, wanted in zip(headers, ids, strict=False):
        if ":" in h and h.partition(":")[2].lower() != wanted:
            raise LoadGraphError(f"Header '{h}' in '{path}' should be ':{wanted}'")
    if len(headers) < len(ids):
        raise LoadGraphError(f"'{path}' needs columns {ids}")
    out = []
    for h in headers[len(ids) :]:
        name, _, kind = h.partition(":")
        kind = kind.lower() or "string"
        if kind not in TYPES:
            raise LoadGraphError(f"Unknown type '{kind}' of property '{name}' in '{path}'")
        out.append((name, kind))
    return out


def _properties(rows: DataFrame, schema: list[tuple[str, str]], first: int, ids: list[Column]) -> DataFrame:
    cells = rows.select(*ids, *[F.col(f"c{first + i}").alias(f"__{n}") for i, (n, _) in enumerate(schema)])
    structural = [c for c in cells.columns if c not in {f"__{n}" for n, _ in schema}]
    return cells.select(*structural, *[_typed(n, k, F.col(f"__{n}")).alias(n) for n, k in schema])


def load_graph(spark: SparkSession, edges: str, vertices: str | None = None, separator: str = ",", comment: str | None = None, has_headers: bool = True, randomize: bool = False, seed: int = 0) -> Graph:
    """Read a graph. Without a vertex file, vertices are numbered as they first appear among the edges' ends."""
    if len(separator) != 1 or (comment is not None and len(comment) != 1):
        raise LoadGraphError("separator and comment are single characters")
    nodes = None
    if vertices:
        headers = _header(spark, vertices, separator, comment)
        schema = _schema(headers, ["id"], vertices) if has_headers else []
        rows = read_rows(spark, vertices, len(headers), separator, comment, has_headers)
        nodes = dense_ids(_properties(rows, schema, 1, [F.col("c0").alias("ext_id")]), "id")
        if not nodes.filter("ext_id IS NULL").isEmpty():
            raise LoadGraphError(f"Empty vertex id in '{vertices}'")
        twice = nodes.groupBy("ext_id").count().filter("count > 1").first()
        if twice:
            raise LoadGraphError(f"Vertex id '{twice['ext_id']}' is in '{vertices}' twice")
    headers = _header(spark, edges, separator, comment)
    schema = _schema(headers, ["start_id", "end_id"], edges) if has_headers else []
    rows = read_rows(spark, edges, len(headers), separator, comment, has_headers)
    links = dense_ids(_properties(rows, schema, 2, [F.col("c0").alias("__s"), F.col("c1").alias("__d")]), "__pos")
    if nodes is None:
        # a source without a target still makes its vertex, as does nothing after an empty source
        ends = links.filter("__s IS NOT NULL").select(F.explode(F.array(F.struct(F.col("__s").alias("ext_id"), (2 * F.col("__pos")).alias("at")), F.struct(F.col("__d").alias("ext_id"), (2 * F.col("__pos") + 1).alias("at")))).alias("e")).select("e.*")
        first = ends.filter("ext_id IS NOT NULL").groupBy("ext_id").agg(F.min("at").alias("at"))
        nodes = dense_ids(first.orderBy("at").select("ext_id"), "id")
    s, d = nodes.select(F.col("ext_id").alias("__s"), F.col("id").alias("src")), nodes.select(F.col("ext_id").alias("__d"), F.col("id").alias("dst"))
    found = links.join(s, "__s").join(d, "__d")
    order = [F.rand(seed), F.col("__pos")] if randomize else [F.col("__pos")]
    numbered = dense_ids(found.orderBy(*order), "id").select("id", "src", "dst", *[n for n, _ in schema])
    vertex_columns = [c for c in nodes.columns if c not in ("id", "ext_id")]
    return Graph(keep(nodes.select("id", "ext_id", *vertex_columns), "vertices"), keep(numbered, "edges"))


def _one_file(lines: DataFrame, path: str) -> None:
    """Text lines to a folder of part files, in the lines' order of partitions."""
    lines.write.mode("overwrite").text(path)


def save_mappings(graph: Graph, path: str) -> None:
    """``ext_id,id`` lines in folder vertex_mappings.txt."""
    _one_file(graph.vertices.select(F.concat_ws(",", "ext_id", "id").alias("value")), f"{path}/vertex_mappings.txt")


def save_graph(graph: Graph, path: str) -> None:
    """Ids in vertices.txt and ``src,dst`` in edges.txt, each a folder of part files."""
    _one_file(graph.vertices.select(F.col("id").cast("string").alias("value")), f"{path}/vertices.txt")
    _one_file(graph.edges.select(F.concat_ws(",", "src", "dst").alias("value")), f"{path}/edges.txt")
