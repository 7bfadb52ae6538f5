"""Query of the URL filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from commitlens.llm.register import query, table
from commitlens.llm.urls import ALLOW, BLOCK, Rule, host_rule, judge

#: Rules that have a name rank above these, the method's own.
GLOBS = ("casino", "free-bets", "cheap-pills", "spam-farm", "adult", "ads-track")
RULES = [
    host_rule("org/", ALLOW),
    host_rule("example.org/es/", BLOCK),
    host_rule("example.org/en/1", BLOCK),
    host_rule("com/fr/", ALLOW),
    host_rule("com/de/", BLOCK),
    *(Rule(f"*.{word}*.*", BLOCK, rank=-1) for word in GLOBS),
    *(Rule(f"*.{word}*.*/**", BLOCK, rank=-1) for word in GLOBS),
]

SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM u)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches('.' || host, '\.(casino|free-bets|cheap-pills|spam-farm|adult|ads-track).*\.') THEN 'block'
  ELSE 'allow' END AS verdict
FROM r
"""


@query("op6_urls", SQL)
def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")
