"""op9_quality_rules: the ledger over ``documents`` under policy v1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm import quality_rules as Q
from glyphloom.llm.common import read_table


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = Q.apply_policy(Q.apply_policy(Q.ledger(docs), "base", "base_kept"), "v1", "kept")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("base_kept")).alias("base_failed"), "kept", F.col("failed").cast("long").alias("failed_bits"),
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), hit AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n >= 2
), cov AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM hit, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(length(t) - length(regexp_replace(t, '\p{L}', '', 'g')) AS BIGINT) AS n_letters
  FROM w LEFT JOIN cov USING (rid)
), b AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * n_symbols > 30 * greatest(n_words, 1) THEN 4 ELSE 0 END)
    + (CASE WHEN 100 * n_dup_lines > 50 * greatest(n_lines, 1) THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars > 25 * greatest(n_words, 1) THEN 16 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * greatest(n_words, 1) THEN 32 ELSE 0 END)
    + (CASE WHEN 100 * n_letters < 50 * word_chars THEN 64 ELSE 0 END) AS bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (bits & 3) <> 0 AS base_failed, (bits & 63) = 0 AS kept, CAST(bits AS BIGINT) AS failed_bits
FROM b
"""
