"""op2: near-duplicate documents by shingles of two words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from viewloom.llm.minhash import Settings, near_duplicates


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Settings(words=2))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS inter FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * inter >= 80 * (x.n + y.n - inter)
), r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT u, min(v) AS m FROM r GROUP BY u) c ON c.u = d.doc_id
"""
