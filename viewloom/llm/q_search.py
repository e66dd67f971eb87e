"""op8: the ten best documents for each document whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.llm.search import top_k


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return top_k(docs, docs.filter(F.col("doc_id") % 100 == 0))


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), f AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS t FROM w) GROUP BY ALL
), c AS (SELECT count(*) AS n, greatest(1, sum(len(ws))) / count(*) AS mean FROM w
), d AS (SELECT t, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM f, c GROUP BY t
), q AS (
  SELECT doc_id AS query_id, t, idf FROM f JOIN d USING (t) WHERE doc_id % 100 = 0
), s AS (
  SELECT query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))), 6) AS score
  FROM q JOIN f USING (t) JOIN w USING (doc_id), c GROUP BY ALL
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s
QUALIFY rank <= 10
"""
