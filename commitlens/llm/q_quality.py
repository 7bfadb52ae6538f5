"""Query of the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from commitlens.llm.quality import quality
from commitlens.llm.register import query, table

#: The fences of the SQL are written out on their own: slack and spread as in ``Rules``.
SQL = r"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS x,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
wins AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM t)),
again AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM again, (VALUES (0), (1), (2)) v(d) GROUP BY doc_id),
base AS (
  SELECT t.doc_id, lang, source, len(ws)::BIGINT AS n_words,
         length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(x, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
  FROM t LEFT JOIN rep USING (doc_id)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS symbols,
         CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_lines,
         CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeats,
         CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS word_len
  FROM base),
long AS (
  SELECT lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'word_len']) AS measure,
         unnest([symbols, dup_lines, repeats, word_len]) AS v
  FROM judged WHERE NOT base_failed),
bins AS (
  SELECT lang, source, measure,
         (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bin, count(*) AS n
  FROM long GROUP BY ALL),
levels AS (
  SELECT 1 AS lvl, lang, source, measure, bin, sum(n) AS n FROM bins GROUP BY ALL
  UNION ALL SELECT 2, lang, NULL, measure, bin, sum(n) FROM bins GROUP BY ALL
  UNION ALL SELECT 3, NULL, NULL, measure, bin, sum(n) FROM bins GROUP BY ALL),
run AS (
  SELECT *, sum(n) OVER (PARTITION BY lvl, lang, source, measure ORDER BY bin) AS upto,
         sum(n) OVER (PARTITION BY lvl, lang, source, measure) AS docs FROM levels),
quart AS (
  SELECT lvl, lang, source, measure, max(docs) AS docs,
         min(bin) FILTER (WHERE upto * 4 >= docs) AS q1, min(bin) FILTER (WHERE upto * 4 >= docs * 3) AS q3
  FROM run GROUP BY ALL),
bounds AS (
  SELECT a.lang, a.source, a.measure,
         CASE WHEN a.docs >= 200 THEN a.q1 WHEN b.docs >= 200 THEN b.q1 ELSE c.q1 END AS q1,
         CASE WHEN a.docs >= 200 THEN a.q3 WHEN b.docs >= 200 THEN b.q3 ELSE c.q3 END AS q3
  FROM quart a
  JOIN quart b ON b.lvl = 2 AND a.measure = b.measure AND a.lang IS NOT DISTINCT FROM b.lang
  JOIN quart c ON c.lvl = 3 AND a.measure = c.measure
  WHERE a.lvl = 1),
wide AS (
  SELECT lang, source,
         max(q3 + greatest(3 * (q3 - q1), 100)) FILTER (WHERE measure = 'symbols') AS symbols_high,
         max(q3 + greatest(3 * (q3 - q1), 300)) FILTER (WHERE measure = 'dup_lines') AS dup_lines_high,
         max(q3 + greatest(3 * (q3 - q1), 300)) FILTER (WHERE measure = 'repeats') AS repeats_high,
         max(q3 + greatest(3 * (q3 - q1), 2000)) FILTER (WHERE measure = 'word_len') AS word_len_high,
         max(q1 - greatest(3 * (q3 - q1), 2000)) FILTER (WHERE measure = 'word_len') AS word_len_low
  FROM bounds GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(NOT base_failed AND symbols <= symbols_high AND dup_lines <= dup_lines_high
                AND repeats <= repeats_high AND word_len BETWEEN word_len_low AND word_len_high, false) AS kept
FROM judged j LEFT JOIN wide w
  ON j.lang IS NOT DISTINCT FROM w.lang AND j.source IS NOT DISTINCT FROM w.source
"""


@query("op2_quality", SQL)
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality(docs).drop("lang", "source")
