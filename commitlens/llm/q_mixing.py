"""Query of the source mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from commitlens.llm.mixing import mix
from commitlens.llm.register import query, table

SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS weight FROM s),
f AS (
  SELECT *, row_number() OVER o AS turn,
         (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (
            ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS lft,
         (sum(weight) OVER () - coalesce(sum(weight) OVER (
            ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS heavy
  FROM r WINDOW o AS (ORDER BY source_size / weight, place)),
lam AS (SELECT arg_min(lft / heavy, turn) AS lam FROM f WHERE lft * weight <= 3 * source_size * heavy),
t AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, coalesce(lam, 0) * weight) AS target FROM f, lam),
g AS (
  SELECT d.source, h, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
p AS (
  SELECT t.*, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM t),
c AS (
  SELECT g.source, h, words, target - passes * source_size AS rest,
         sum(words) OVER (PARTITION BY g.source ORDER BY h) AS upto
  FROM g JOIN p ON g.source IS NOT DISTINCT FROM p.source),
e AS (
  SELECT source, min(h) AS h, arg_min(2 * (rest - (upto - words)) >= words, h) AS nearer
  FROM c WHERE upto > rest GROUP BY source)
SELECT d.doc_id, d.size, p.source_size, p.target,
       d.size * (p.passes + CASE WHEN d.h < e.h OR (d.h = e.h AND e.nearer) THEN 1 ELSE 0 END) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""


@query("op10_mixing", SQL)
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
