"""Property graphs over the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewloom.graph import Graph

SUPPLIERS = 10_000_000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers and customers, an edge from supplier to customer for each line of an order."""
    places = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = _read(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    suppliers = _read(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    vertices = customers.select(F.col("c_custkey").cast("long").alias("id"), F.lit("C").alias("kind"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("r_name").alias("region")).unionByName(
        suppliers.select((F.col("s_suppkey") + SUPPLIERS).cast("long").alias("id"), F.lit("S").alias("kind"), F.lit(None).cast("string").alias("segment"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    )
    lines = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = lines.select(
        F.monotonically_increasing_id().alias("id"), (F.col("l_suppkey") + SUPPLIERS).cast("long").alias("src"), F.col("o_custkey").cast("long").alias("dst"),
        F.year("o_orderdate").cast("long").alias("year"), F.col("l_quantity").cast("long").alias("qty"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
    )
    return Graph(vertices, edges)


def transitions(spark: SparkSession, sf_dir: str) -> Graph:
    """Users, an edge from each event's user to the next event's user.

    The order of all events is global: events are dealt to hours, the next user is found within each hour, and an hour's
    last event gets the first user of the next hour that has any, from a table of a row per hour.
    """
    events = _read(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    w = Window.partitionBy("hour").orderBy("ts", "event_id")
    near = events.withColumn("next", F.lead("user_id").over(w))
    first = events.groupBy("hour").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"))
    later = first.select("hour", F.lead("first").over(Window.orderBy("hour")).alias("later"))
    found = near.join(later, "hour").withColumn("dst", F.coalesce("next", "later")).filter("dst IS NOT NULL")
    edges = found.select(F.col("event_id").cast("long").alias("id"), F.col("user_id").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("event_type"), F.floor(F.col("value") * 100).cast("long").alias("cents"))
    vertices = events.select(F.col("user_id").cast("long").alias("id")).distinct()
    return Graph(vertices, edges)
