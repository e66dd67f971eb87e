"""op7: every document's ids, an end id after each, in sequences of 4096."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from viewloom.llm.packing import pack

END_ID = 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), END_ID)
