"""Query of the collocations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from commitlens.llm.phrases import collocations
from commitlens.llm.register import query, table

SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (
  SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w
  UNION ALL
  SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
  UNION ALL
  SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS a FROM g GROUP BY ALL),
sizes AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
cuts AS (
  SELECT lang, phrase, k, a, 1 AS cut, ws[1] AS first_part, array_to_string(ws[2:], ' ') AS rest FROM c
  UNION ALL
  SELECT lang, phrase, k, a, 2, ws[1] || ' ' || ws[2], ws[3] FROM c WHERE k = 3),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, cut, x.a AS l, y.a AS r,
         (1000000::HUGEINT * cuts.a * cuts.a // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first_part
  JOIN f y ON y.lang = cuts.lang AND y.phrase = rest),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS turn FROM scored) WHERE turn = 1),
longer AS (
  SELECT lang, part, max(a) AS most
  FROM (SELECT lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS part FROM c WHERE k = 3) GROUP BY lang, part),
ranked AS (
  SELECT best.lang, phrase, a, l, r, score,
         row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best LEFT JOIN longer ON longer.lang = best.lang AND part = phrase
  WHERE part IS NULL OR 100 * most < 50 * a)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""


@query("op11_phrases", SQL)
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))
