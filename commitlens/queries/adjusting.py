"""Queries on outlier commits, adjusted pairs and research tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from commitlens.operators import stats
from commitlens.operators.ranking import group_quantiles
from commitlens.queries.oracle import sql
from commitlens.queries.registry import query, rounded
from commitlens.sources import layout

ONE_REPO = "repo_7"


@query("quantile_thresholds", sql("SELECT * FROM thresholds", "flagged"))
def quantile_thresholds(t):
    return t.adjustment.thresholds


@query("threshold_join", sql("SELECT * FROM flagged", "flagged"))
def threshold_join(t):
    return t.adjustment.flagged


@query("outlier_commits", sql("SELECT * FROM outliers", "flagged"))
def outlier_commits(t):
    return t.adjustment.outliers


@query(
    "concat_outliers",
    sql("SELECT repository, count(*) AS outliers FROM outliers GROUP BY ALL", "flagged"),
)
def concat_outliers(t):
    return t.adjustment.outliers.groupBy("repository").agg(F.count("*").alias("outliers"))


@query("outlier_semi", sql("SELECT * FROM adjusted", "adjusted"))
def outlier_semi(t):
    return t.adjustment.pairs


@query(
    "outlier_summary",
    sql("""SELECT repository, commit_size_rows, pairs_rows, 0.99::DOUBLE AS q_lines,
      0.99::DOUBLE AS q_files, thr_lines, thr_files, outlier_commits, outlier_commit_fraction,
      same_commit_pairs, same_commit_pairs_relabeled,
      CASE WHEN same_commit_pairs > 0 THEN same_commit_pairs_relabeled / same_commit_pairs
           ELSE 0.0 END AS same_commit_pairs_relabeled_fraction
      FROM (SELECT repository, count(*) AS commit_size_rows, max(thr_lines) AS thr_lines,
                   max(thr_files) AS thr_files,
                   count(DISTINCT commit_hash) FILTER (is_outlier) AS outlier_commits,
                   count(*) FILTER (is_outlier) / count(*) AS outlier_commit_fraction
            FROM flagged GROUP BY repository)
      JOIN (SELECT repository, count(*) AS pairs_rows,
                   count(*) FILTER (classification = 'SAME_COMMIT') AS same_commit_pairs,
                   count(*) FILTER (same_commit_is_outlier) AS same_commit_pairs_relabeled
            FROM adjusted GROUP BY repository) USING (repository)""", "adjusted"),
)
def outlier_summary(t):
    return t.adjustment.audit


@query(
    "sort_multi",
    sql("""SELECT repository, relabeled / same AS fraction, same FROM (
      SELECT repository, count(*) FILTER (classification = 'SAME_COMMIT') AS same,
             count(*) FILTER (same_commit_is_outlier) AS relabeled
      FROM adjusted GROUP BY repository) WHERE same > 0""", "adjusted"),
)
def sort_multi(t):
    audit = t.adjustment.audit.where("same_commit_pairs > 0")
    return audit.select(
        "repository",
        F.col("same_commit_pairs_relabeled_fraction").alias("fraction"),
        F.col("same_commit_pairs").alias("same"),
    ).orderBy(F.desc("fraction"), F.desc("same"))


@query(
    "value_distribution",
    sql("""SELECT 'original' AS label, classification AS value, count(*) AS count,
        count(*) / (SELECT count(*) FROM adjusted) AS proportion FROM adjusted GROUP BY ALL
      UNION ALL
      SELECT 'adjusted', classification_adj, count(*),
        count(*) / (SELECT count(*) FROM adjusted) FROM adjusted GROUP BY ALL""", "adjusted"),
)
def value_distribution(t):
    pairs = t.adjustment.pairs
    before = stats.value_distribution(pairs, "classification")
    after = stats.value_distribution(pairs, "classification_adj")
    return before.withColumn("label", F.lit("original")).unionByName(
        after.withColumn("label", F.lit("adjusted"))
    )


@query(
    "proportion_of_total",
    sql("""SELECT change_type AS value, count(*) AS count,
      count(*) / (SELECT count(*) FROM file_changes) AS proportion
      FROM file_changes GROUP BY ALL""", "file_changes"),
)
def proportion_of_total(t):
    return stats.value_distribution(t.changes, "change_type")


@query("summary_adjusted", sql("SELECT * FROM summary_adjusted", "summary_adjusted"))
def summary_adjusted(t):
    return t.adjustment.summary


ADJUSTED = ("test_first_adj_pct", "prod_first_adj_pct", "same_commit_adj_pct")


def _melted(columns, table):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS metric, {c} AS value FROM {table}" for c in columns
    )


@query(
    "numeric_stats",
    sql(f"""SELECT metric, count(value) AS count, round(avg(value), 6) AS mean,
      round(stddev_samp(value), 6) AS std_dev, min(value) AS min, max(value) AS max
      FROM ({_melted(ADJUSTED, 'summary_adjusted')}) GROUP BY metric""", "summary_adjusted"),
)
def numeric_stats(t):
    return rounded(
        stats.numeric_stats(t.adjustment.summary, list(ADJUSTED)), "mean", "std_dev"
    )


@query(
    "histogram_25",
    sql(f"""SELECT metric, bin, CAST(sum(raw) AS BIGINT) AS with_outliers,
      CAST(sum(adj) AS BIGINT) AS without_outliers FROM (
        SELECT replace(replace(metric, '_adj_pct', ''), '_pct', '') AS metric,
               least(CAST(floor(value / 4) AS BIGINT) + 1, 25) AS bin,
               CASE WHEN contains(metric, '_adj') THEN 0 ELSE 1 END AS raw,
               CASE WHEN contains(metric, '_adj') THEN 1 ELSE 0 END AS adj
        FROM ({_melted(
            [f'{k}{a}_pct' for k in ('test_first', 'prod_first', 'same_commit')
             for a in ('', '_adj')], 'summary_adjusted')}))
      GROUP BY metric, bin""", "summary_adjusted"),
)
def histogram_25(t):
    return stats.histogram_overlay(t.adjustment.summary)


def box_sql(source: str, key: str, value: str) -> str:
    return f"""SELECT {key}, n, round(mean, 6) AS mean, round(median, 6) AS median,
        round(q1, 6) AS q1, round(q3, 6) AS q3,
        least(q1, (SELECT min({value}) FROM {source} s WHERE s.{key} = b.{key}
                   AND {value} >= q1 - 1.5 * (q3 - q1))) AS whisker_low,
        greatest(q3, (SELECT max({value}) FROM {source} s WHERE s.{key} = b.{key}
                   AND {value} <= q3 + 1.5 * (q3 - q1))) AS whisker_high
      FROM (SELECT {key}, count({value}) AS n, avg({value}) AS mean,
                   quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 0.25) AS q1,
                   quantile_cont({value}, 0.75) AS q3
            FROM {source} GROUP BY {key}) b"""


@query("box_stats_by_group", box_sql("customer", "c_mktsegment", "c_acctbal"))
def box_stats_by_group(t):
    boxes = stats.box_stats(t.given("customer"), ["c_mktsegment"], "c_acctbal")
    return rounded(boxes, "mean", "median", "q1", "q3")


@query(
    "percentage_boxes",
    sql(
        f"""SELECT * FROM (WITH melted AS ({_melted(ADJUSTED, "summary_adjusted")})
        {box_sql("melted", "metric", "value")})""",
        "summary_adjusted",
    ),
)
def percentage_boxes(t):
    long = stats.melt(t.adjustment.summary, [], stats.numbers(list(ADJUSTED)))
    return rounded(stats.box_stats(long, ["metric"], "value"), "mean", "median", "q1", "q3")


def size_box_sql(where: str) -> str:
    return f"""SELECT classification, count(*) AS n, avg(size) AS mean,
        quantile_cont(size, 0.25) AS q1, quantile_cont(size, 0.5) AS median,
        quantile_cont(size, 0.75) AS q3, quantile_cont(size, 0.05) AS p5,
        quantile_cont(size, 0.95) AS p95
      FROM (SELECT classification, CAST(test_commit_total_lines + prod_commit_total_lines
                                        AS DOUBLE) AS size
            FROM adjusted WHERE {where}) WHERE size >= 1 GROUP BY classification"""


@query(
    "size_box_stats",
    sql(size_box_sql("NOT coalesce(same_commit_is_outlier, false)"), "adjusted"),
)
def size_box_stats(t):
    return stats.size_box_stats(t.adjustment.pairs)


@query("sort_preferred_order", sql(size_box_sql("true"), "adjusted"))
def sort_preferred_order(t):
    boxes = stats.size_box_stats(t.adjustment.pairs, with_outliers=True)
    return stats.in_preferred_order(boxes, "classification")


def mean_median_sql(where: str) -> str:
    sizes = {}
    for m in ("commit_total_lines", "commit_files", "commit_java_files"):
        sizes |= {
            f"test_{m}": f"test_{m}",
            f"prod_{m}": f"prod_{m}",
            f"sum_{m}": f"(test_{m} + prod_{m})",
        }
    columns = [f"avg({e}) AS {n}__mean" for n, e in sizes.items()]
    columns += [f"median({e}::DOUBLE) AS {n}__median" for n, e in sizes.items()]
    return f"""SELECT classification, {', '.join(columns)}, count(*) AS n_rows
      FROM adjusted WHERE {where} GROUP BY classification"""


@query("size_mean_median", sql(mean_median_sql("true"), "adjusted"))
def size_mean_median(t):
    return stats.size_mean_median(t.adjustment.pairs)


@query(
    "size_mean_median_no_outliers",
    sql(mean_median_sql("NOT coalesce(same_commit_is_outlier, false)"), "adjusted"),
)
def size_mean_median_no_outliers(t):
    return stats.size_mean_median(t.adjustment.pairs, with_outliers=False)


@query(
    "filter_outliers_optional",
    sql("""SELECT repository, test_file, prod_file, classification FROM adjusted
      WHERE NOT coalesce(same_commit_is_outlier, false)""", "adjusted"),
)
def filter_outliers_optional(t):
    return stats.drop_outliers(t.adjustment.pairs).select(
        "repository", "test_file", "prod_file", "classification"
    )


@query(
    "filter_min_size",
    sql("""SELECT repository, commit_hash, total_lines_added::DOUBLE AS size FROM commits_table
      WHERE total_lines_added >= 100""", "commits_table"),
)
def filter_min_size(t):
    sized = t.commits_table.select(
        "repository", "commit_hash", F.col("total_lines_added").cast("double").alias("size")
    )
    return stats.at_least(sized, "size", 100.0)


SCATTER = f"""
SELECT c.repository, row_number() OVER (ORDER BY c.commit_date, c.commit_hash) - 1
         AS commit_index, c.commit_hash, c.commit_date, c.total_lines_added,
       c.total_files_count, coalesce(out_due_to_lines, false) AS is_outlier_lines,
       coalesce(out_due_to_files, false) AS is_outlier_files
FROM commits_table c LEFT JOIN outliers o
  ON o.repository = c.repository AND o.commit_hash = c.commit_hash
WHERE c.repository = '{ONE_REPO}'"""


@query("scatter_join", sql(SCATTER, "flagged"))
def scatter_join(t):
    return stats.scatter_data(t.commits_table, t.adjustment.outliers, ONE_REPO)


@query(
    "commit_index",
    sql("""SELECT repository, commit_hash, row_number() OVER (PARTITION BY repository
      ORDER BY commit_date, commit_hash) - 1 AS commit_index FROM commits_table""",
        "commits_table"),
)
def commit_index(t):
    return stats.commit_index(t.commits_table).select(
        "repository", "commit_hash", "commit_index"
    )


@query(
    "filter_one_repo",
    sql(f"SELECT * FROM commits_table WHERE repository = '{ONE_REPO}'", "commits_table"),
)
def filter_one_repo(t):
    return layout.one_repository(t.commits_table, ONE_REPO)


@query(
    "hot_group_quantiles",
    """SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25,
         round(quantile_cont(l_extendedprice, 0.5), 6) AS q50,
         round(quantile_cont(l_extendedprice, 0.99), 6) AS q99
       FROM lineitem GROUP BY l_returnflag""",
)
def hot_group_quantiles(t):
    lines = t.given("lineitem").select("l_returnflag", "l_extendedprice")
    found = group_quantiles(
        lines, ["l_returnflag"], "l_extendedprice", {"q25": 0.25, "q50": 0.5, "q99": 0.99}
    )
    return rounded(found, "q25", "q50", "q99")


@query(
    "supplier_outlier_lines",
    """WITH thr AS (SELECT l_suppkey, quantile_cont(l_quantity, 0.99) AS threshold
         FROM lineitem GROUP BY l_suppkey)
       SELECT l_suppkey, threshold, count(*) AS lines,
              count(*) FILTER (l_quantity >= threshold) AS outliers
       FROM lineitem JOIN thr USING (l_suppkey) GROUP BY ALL""",
)
def supplier_outlier_lines(t):
    lines = t.given("lineitem").select("l_suppkey", "l_quantity")
    thresholds = group_quantiles(lines, ["l_suppkey"], "l_quantity", {"threshold": 0.99})
    return (
        lines.join(thresholds.drop("n"), "l_suppkey")
        .groupBy("l_suppkey", "threshold")
        .agg(
            F.count("*").alias("lines"),
            F.count_if(F.col("l_quantity") >= F.col("threshold")).alias("outliers"),
        )
    )
