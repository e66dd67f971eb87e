"""op5: the language of every document, learned from the labelled documents that are not held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.llm.langid import learn, predict


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = learn(docs, ~held_out())
    return predict(docs, net, "text", "doc_id").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
