"""A training-data pipeline over the documents: language, near duplicates, benchmark items, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; its result is written and reread.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.llm.decontam import contaminated
from viewloom.llm.langid import UNKNOWN, learn, predict
from viewloom.llm.minhash import Settings, one_of_each, row_key, without
from viewloom.llm.packing import pack
from viewloom.llm.q_langid import held_out
from viewloom.llm.q_packing import END_ID
from viewloom.llm.secrets import redact
from viewloom.llm.store import keep
from viewloom.llm.worker import fresh

#: Texts whose most likely language has less than this are in none of the learned languages.
LEAST_SCORE = 0.3
#: Words whose ids a worker holds; workers that went through other stages have less to spare.
WORDS_HELD = 300_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without letters or of no clear language go."""
    lang, score = fresh(docs.columns, "lang_pred", "score")
    told = predict(docs, learn(docs, ~held_out()), "text", *docs.columns, names=(lang, score))
    return told.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id."""
    return one_of_each(docs, Settings(words=5, percent=80))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows = docs.select(row_key().alias("doc_id"), "text")  # rows may share an id
    return without(docs, contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id"))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of each secret."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in training sequences."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, cached=WORDS_HELD)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("MinHash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("secret scans", remove_secrets),
    ("packing", sequences),
]

#: SQL expresses neither the language model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
