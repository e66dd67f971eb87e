"""op6: the documents that hold benchmark items, and which."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from viewloom.llm.decontam import contaminated


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
