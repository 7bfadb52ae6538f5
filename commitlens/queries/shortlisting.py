"""Queries on repository metadata, trees, shortlists and plain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from commitlens.functions import paths, values
from commitlens.operators import funnel, stats
from commitlens.plans import shortlist
from commitlens.queries import derived
from commitlens.queries.oracle import sql
from commitlens.queries.registry import query, rounded

TREE_COLUMNS = ["java_files", "test_files", "num_commits", "project_life_days", "test_ratio"]


def flat_meta(t):
    return derived.repo_meta(t.spark, t.sf_dir).selectExpr(
        "* except (license)", "license.spdx_id as spdx_id"
    )


@query(
    "repo_commit_span",
    sql("""SELECT repo, count(*) AS num_commits, min(commit_date) AS first_commit_date,
      max(commit_date) AS last_commit_date,
      arg_min(commit_hash, (commit_date, commit_hash)) AS first_commit,
      arg_max(commit_hash, (commit_date, commit_hash)) AS last_commit,
      arg_min(author, (commit_date, commit_hash)) AS first_author,
      arg_max(author, (commit_date, commit_hash)) AS last_author
      FROM commit_stats GROUP BY repo""", "commit_stats"),
)
def repo_commit_span(t):
    return funnel.repo_commit_span(t.commit_stats)


@query("project_repo_stats", sql("SELECT * FROM repo_stats", "repo_stats"))
def project_repo_stats(t):
    return t.repo_stats


@query(
    "project_life_days",
    """SELECT user_id, CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 AS DOUBLE)
         AS project_life_days FROM events GROUP BY user_id""",
)
def project_life_days(t):
    spans = t.given("events").groupBy("user_id").agg(
        F.min("ts").alias("first_commit_date"), F.max("ts").alias("last_commit_date")
    )
    return funnel.project_life_days(spans).select("user_id", "project_life_days")


@query(
    "filter_mature_repos",
    sql("""SELECT * FROM repo_stats WHERE main_language = 'Java' AND num_commits > 500
      AND project_life_days > 365""", "repo_stats"),
)
def filter_mature_repos(t):
    return funnel.filter_mature(t.repo_stats)


@query(
    "filter_repo_meta",
    sql("""SELECT * FROM repo_meta WHERE NOT fork AND NOT archived AND language = 'Java'
      AND size BETWEEN 300 AND 50000000 AND spdx_id = 'Apache-2.0'""", "repo_meta"),
)
def filter_repo_meta(t):
    kept = funnel.filter_repo_meta(
        derived.repo_meta(t.spark, t.sf_dir), language="Java", min_size=300, max_size=50_000_000
    )
    return kept.selectExpr("* except (license)", "license.spdx_id as spdx_id")


@query("filter_language", sql("SELECT * FROM repo_meta WHERE language = 'Scala'", "repo_meta"))
def filter_language(t):
    return flat_meta(t).where("language = 'Scala'")


@query("scan_repo_tree", sql("SELECT * FROM repo_tree", "repo_tree"))
def scan_repo_tree(t):
    return t.repo_tree


@query(
    "tree_file_predicates",
    sql("""SELECT repo, path, regexp_matches(regexp_replace(path, '^.*/', ''),
        '^(?:.*(?:Test|Tests|TestCase|IT|ITCase|Spec)|Test.*)\\.java$') AS is_test
      FROM repo_tree WHERE type = 'blob' AND path LIKE '%.java'""", "repo_tree"),
)
def tree_file_predicates(t):
    java = paths.tree_java_file(F.col("path"), F.col("type"))
    return t.repo_tree.where(java).select(
        "repo", "path", paths.tree_test_file(F.col("path")).alias("is_test")
    )


@query("tree_counts", sql("SELECT * FROM tree_counts", "candidates"))
def tree_counts(t):
    return funnel.tree_counts(t.repo_tree)


@query("root_flags", sql("SELECT * FROM root_flags", "candidates"))
def root_flags(t):
    return funnel.root_flags(t.repo_tree)


@query(
    "has_test_dir",
    sql("""SELECT repo, bool_or(type = 'dir' AND len(string_split(path, '/')) <= 3
      AND lower(string_split(path, '/')[-1]) LIKE '%test%') AS has_test_dir
      FROM repo_tree GROUP BY repo""", "repo_tree"),
)
def has_test_dir(t):
    return funnel.has_test_dir(t.repo_tree)


@query("structure_stats_join", sql("SELECT * FROM structured", "candidates"))
def structure_stats_join(t):
    return funnel.with_structure(t.repo_stats, t.repo_tree)


@query("project_reorder", sql("SELECT * FROM candidates", "candidates"))
def project_reorder(t):
    return t.candidates


@query("filter_final_candidates", sql("SELECT * FROM shortlist", "candidates"))
def filter_final_candidates(t):
    return funnel.filter_final(t.candidates)


@query(
    "sort_candidates",
    sql("SELECT * FROM shortlist ORDER BY test_ratio DESC, repo", "candidates"),
)
def sort_candidates(t):
    return shortlist.shortlist(t.candidates)


@query(
    "missing_rows",
    sql("SELECT * FROM candidates WHERE repo NOT IN (SELECT repo FROM shortlist)", "candidates"),
)
def missing_rows(t):
    return funnel.missing_rows(t.candidates, funnel.filter_final(t.candidates))


@query(
    "difference_by_key",
    """SELECT doc_id, lang, source, n_chars FROM documents
       WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def difference_by_key(t):
    documents = t.given("documents").select("doc_id", "lang", "source", "n_chars")
    return funnel.missing_rows(documents, t.given("labels"), "doc_id")


@query(
    "ceil_chunk",
    """SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1)
         // CAST(ceil((SELECT count(*) FROM orders) / 5) AS BIGINT) + 1 AS part FROM orders""",
)
def ceil_chunk(t):
    orders = t.given("orders").select("o_orderdate", "o_orderkey")
    return funnel.chunks(orders, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "part")


@query(
    "combine_parts",
    """SELECT c_name AS name, c_nationkey AS nation, c_acctbal AS balance,
              c_mktsegment AS segment FROM customer
       UNION ALL SELECT s_name, s_nationkey, s_acctbal, NULL FROM supplier""",
)
def combine_parts(t):
    customers = t.given("customer").selectExpr(
        "c_name as name", "c_nationkey as nation", "c_acctbal as balance",
        "c_mktsegment as segment",
    )
    suppliers = t.given("supplier").selectExpr(
        "s_acctbal as balance", "s_name as name", "s_nationkey as nation"
    )
    return funnel.combine([customers, suppliers])


@query(
    "top_n_by",
    sql("""(SELECT 'commits' AS by, repo, num_commits AS value FROM repo_stats
        ORDER BY num_commits DESC, repo LIMIT 10)
      UNION ALL
      (SELECT 'life', repo, project_life_days FROM repo_stats
        ORDER BY project_life_days DESC, repo LIMIT 10)""", "repo_stats"),
)
def top_n_by(t):
    def top(label, column):
        rows = funnel.top_n(t.repo_stats, column)
        return rows.select(F.lit(label).alias("by"), "repo", F.col(column).alias("value"))

    return top("commits", "num_commits").unionByName(top("life", "project_life_days"))


@query("head", "SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5")
def head(t):
    return funnel.top_n(t.given("part"), "p_retailprice", 5, tie="p_partkey")


@query(
    "group_value_counts",
    """SELECT p_brand, count(*) AS count FROM part GROUP BY p_brand
       ORDER BY count(*) DESC, p_brand""",
)
def group_value_counts(t):
    return stats.group_value_counts(t.given("part"), "p_brand")


@query(
    "top_k_groups",
    """SELECT p_brand, count(*) AS count FROM part GROUP BY p_brand
       ORDER BY count(*) DESC, p_brand LIMIT 15""",
)
def top_k_groups(t):
    return stats.top_k_groups(t.given("part"), "p_brand")


@query(
    "top_group_semi",
    """SELECT * FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand
       ORDER BY count(*) DESC, p_brand LIMIT 15)""",
)
def top_group_semi(t):
    return stats.top_group_rows(t.given("part"), "p_brand")


def describe_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS metric, count({c}) AS count, round(avg({c}), 6) AS mean,
          round(stddev_samp({c}), 6) AS std_dev, min({c})::DOUBLE AS min,
          max({c})::DOUBLE AS max, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS p25,
          round(quantile_cont({c}::DOUBLE, 0.5), 6) AS p50,
          round(quantile_cont({c}::DOUBLE, 0.75), 6) AS p75 FROM {table}"""
        for c in columns
    )


@query("describe_table", describe_sql("part", ["p_retailprice", "p_size", "p_partkey"]))
def describe_table(t):
    described = stats.describe_table(t.given("part"), ["p_retailprice", "p_size", "p_partkey"])
    return rounded(described, "mean", "std_dev", "p25", "p50", "p75")


@query(
    "describe_repo_stats",
    sql(
        describe_sql("repo_stats", ["stars", "forks", "num_commits", "project_life_days"]),
        "repo_stats",
    ),
)
def describe_repo_stats(t):
    described = stats.describe_table(
        t.repo_stats, ["stars", "forks", "num_commits", "project_life_days"]
    )
    return rounded(described, "mean", "std_dev", "p25", "p50", "p75")


@query(
    "column_stats_transposed",
    sql(
        f"""SELECT metric, min, p50 AS median, max, mean, std_dev AS std
        FROM ({describe_sql('candidates', TREE_COLUMNS)})""",
        "candidates",
    ),
)
def column_stats_transposed(t):
    return rounded(
        stats.column_stats_transposed(t.candidates, TREE_COLUMNS), "median", "mean", "std"
    )


@query(
    "flag_adoption",
    sql(" UNION ALL ".join(
        f"""SELECT '{f}' AS feature, nullif(count(*) FILTER (NOT {f}), 0) AS no,
          nullif(count(*) FILTER ({f}), 0) AS yes FROM candidates"""
        for f in ("has_ci_system", "has_build_system")
    ), "candidates"),
)
def flag_adoption(t):
    return stats.flag_adoption(t.candidates, ["has_ci_system", "has_build_system"])


@query(
    "yes_no_map",
    sql("""SELECT repo, if(has_ci_system, 'Yes', 'No') AS ci,
      if(has_build_system, 'Yes', 'No') AS build FROM candidates""", "candidates"),
)
def yes_no_map(t):
    return t.candidates.select(
        "repo",
        values.yes_no(F.col("has_ci_system")).alias("ci"),
        values.yes_no(F.col("has_build_system")).alias("build"),
    )


@query(
    "unpivot_stats",
    """SELECT o_orderpriority, 'price' AS metric, o_totalprice AS value FROM orders
       UNION ALL SELECT o_orderpriority, 'customer', o_custkey::DOUBLE FROM orders""",
)
def unpivot_stats(t):
    columns = {"price": F.col("o_totalprice"), "customer": F.col("o_custkey").cast("double")}
    return stats.melt(t.given("orders"), ["o_orderpriority"], columns)


@query(
    "pivot_flags",
    """SELECT s AS feature, nullif(count(*) FILTER (NOT f), 0) AS no,
         nullif(count(*) FILTER (f), 0) AS yes
       FROM (SELECT 'returned' AS s, l_returnflag = 'R' AS f FROM lineitem
             UNION ALL SELECT 'open', l_linestatus = 'O' FROM lineitem) GROUP BY s""",
)
def pivot_flags(t):
    flags = t.given("lineitem").select(
        (F.col("l_returnflag") == "R").alias("returned"), (F.col("l_linestatus") == "O").alias("open")
    )
    return stats.flag_adoption(flags, ["returned", "open"])
