"""A collection that grows by one view with every micro-batch of a stream of edge changes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from viewloom.operators.collection import DiffCollection
from viewloom.operators.timestamps import Timestamps


class GrowingCollection:
    """Each batch's changes (src, dst, diff) are written as the differences of the next view; a batch that is run again replaces itself."""

    def __init__(self, name: str, path: str) -> None:
        self.name, self.path = name, path

    def start(self, changes: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        def view(batch: DataFrame, n: int) -> None:
            rows = batch.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("diff").cast("long"))
            rows.groupBy("src", "dst").agg(F.sum("diff").alias("diff")).filter("diff <> 0").write.mode("overwrite").parquet(f"{self.path}/ts={n}")

        return changes.writeStream.foreachBatch(view).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def collection(self, spark) -> DiffCollection:
        """The views so far."""
        table = spark.read.parquet(self.path)
        rows = table.select(F.col("ts").cast("int").alias("ts"), "src", "dst", "diff")
        # a batch that changed nothing has a file without rows, and is a view
        views = 1 + max((int(m[1]) for m in (re.search(r"/ts=(\d+)/", f) for f in table.inputFiles()) if m), default=-1)
        return DiffCollection(self.name, Timestamps((views,)), [str(i) for i in range(views)], rows)
