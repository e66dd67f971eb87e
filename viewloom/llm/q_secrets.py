"""op3: the secrets of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from viewloom.llm.secrets import ALLOWED, ASSIGN, CLASSES, report


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _found(name: str, pattern: str, kind: str, rank: int, keep: str = "true", group: int = 0) -> str:
    """Matches and their places: the lengths of what lies between matches, and of the matches, added up."""
    p = pattern.replace("'", "''")
    return f"""{name}_m AS (
  SELECT k, regexp_split_to_array(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {group}) AS gs
  FROM d WHERE regexp_matches(t, '{p}')
), {name}_u AS (
  SELECT k, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(gs) AS g, unnest(gaps[:len(ms)]) AS gap FROM {name}_m
), {name}_p AS (
  SELECT k, i, m, g, sum(length(gap) + length(m)) OVER (PARTITION BY k ORDER BY i) AS stop FROM {name}_u
), {name} AS (
  SELECT k, CAST(stop - length(m) AS BIGINT) AS s, CAST(stop AS BIGINT) AS e, '{kind}' AS kind, {rank} AS r, m FROM {name}_p WHERE {keep}
)"""


def _entropy(name: str, c, rank: int, against: list[str]) -> str:
    benign = "^(" + "|".join(f"({a})" for a in ALLOWED) + ")$"
    chars = "lower(m)" if c.kind == "entropy_hex" else "m"
    old = " UNION ALL ".join(f"SELECT k, s, e FROM {x}" for x in against)
    return f"""{_found(name + "_c", f"[{c.chars}]{{{c.least},}}", c.kind, rank, f"NOT regexp_matches(m, '{benign}')")},
{name}_w AS (SELECT k, s, m, unnest(range(0, length(m) - {c.width} + 1)) AS o FROM {name}_c),
{name}_l AS (SELECT k, s, m, o, unnest(string_split(substring({chars}, CAST(o + 1 AS BIGINT), {c.width}), '')) AS ch FROM {name}_w),
{name}_n AS (SELECT k, s, m, o, ch, count(*) AS n FROM {name}_l GROUP BY ALL),
{name}_h AS (SELECT k, s, m, o, log2({c.width}) - sum(n * log2(n)) / {c.width} AS bits FROM {name}_n GROUP BY ALL),
{name}_s AS (SELECT k, CAST(s + min(o) AS BIGINT) AS s, CAST(s + max(o) + {c.width} AS BIGINT) AS e, '{c.kind}' AS kind, {rank} AS r FROM {name}_h WHERE bits >= {c.bits} - 1e-9 GROUP BY k, {name}_h.s, m),
{name} AS (SELECT * FROM {name}_s a WHERE NOT EXISTS (SELECT 1 FROM ({old}) b WHERE a.k = b.k AND a.s < b.e AND b.s < a.e))"""


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
{_found("a", ASSIGN, "assign", 0, "length(g) >= 8", 2)},
{_found("b", "AKIA[A-Z0-9]{12,}", "access", 1)},
{_found("c", "[0-9a-f]{32,}", "hex", 2)},
{_entropy("x", CLASSES[0], 3, ["a", "b", "c"])},
{_entropy("y", CLASSES[1], 4, ["a", "b", "c", "x"])},
al AS (
  SELECT k, s, e, kind, r FROM a UNION ALL SELECT k, s, e, kind, r FROM b UNION ALL SELECT k, s, e, kind, r FROM c
  UNION ALL SELECT k, s, e, kind, r FROM x UNION ALL SELECT k, s, e, kind, r FROM y
)
SELECT CAST(any_value(d.doc_id) AS BIGINT) AS doc_id,
  CAST(count(*) FILTER (kind = 'assign') AS BIGINT) AS n_assign, CAST(count(*) FILTER (kind = 'access') AS BIGINT) AS n_access, CAST(count(*) FILTER (kind = 'hex') AS BIGINT) AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r, e) FILTER (r < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r, e) FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN al ON d.k = al.k GROUP BY d.k
"""
