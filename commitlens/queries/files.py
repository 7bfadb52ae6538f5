"""Queries that write tables and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from commitlens import schemas
from commitlens.operators import funnel, stats
from commitlens.plans import shortlist
from commitlens.queries import derived
from commitlens.queries.adjusting import mean_median_sql
from commitlens.queries.oracle import sql
from commitlens.queries.registry import query
from commitlens.queries.scalars import category_sql
from commitlens.sources import readers, writers

# Dates go through text files; they come back with the session's zone (UTC).
NO_ZONE = "timestamp_ntz"


def without_zone(df, *columns):
    return df.withColumns({c: F.col(c).cast(NO_ZONE) for c in columns})


def through_csv(t, df, schema: str, label: str):
    path = t.scratch(label)
    writers.write_csv(df, path)
    return readers.scan_csv(t.spark, path, schema)


@query("scan_csv", sql("SELECT * FROM commits_table", "commits_table"))
def scan_csv(t):
    back = through_csv(t, t.commits_table, schemas.COMMITS, "commits-csv")
    return without_zone(back, "commit_date")


@query(
    "write_commits",
    sql("SELECT * REPLACE (substr(commit_hash, 1, 8) AS commit_hash) FROM commits_table",
        "commits_table"),
)
def write_commits(t):
    path = t.scratch("commits-out")
    writers.write_csv(writers.short_hashes(writers.commits_table(t.commit_stats)), path)
    return without_zone(readers.scan_csv(t.spark, path, schemas.COMMITS), "commit_date")


@query("scan_csv_dates", sql("SELECT * FROM repo_stats", "repo_stats"))
def scan_csv_dates(t):
    path = t.scratch("stats-csv")
    writers.write_csv(t.repo_stats, path)
    dates = ["first_commit_date", "last_commit_date"]
    return without_zone(
        readers.scan_csv_dates(t.spark, path, schemas.REPO_STATS, dates), *dates
    )


@query("write_stats", sql("SELECT * FROM repo_stats", "repo_stats"))
def write_stats(t):
    back = through_csv(t, t.repo_stats, schemas.REPO_STATS, "stats-out")
    return without_zone(back, "first_commit_date", "last_commit_date")


@query("scan_csv_column", sql("SELECT repo FROM repo_stats", "repo_stats"))
def scan_csv_column(t):
    path = t.scratch("column-csv")
    writers.write_csv(t.repo_stats, path)
    return readers.scan_csv_column(t.spark, path, schemas.REPO_STATS, "repo", limit=0)


@query("scan_json_array", sql("SELECT * FROM repo_meta", "repo_meta"))
def scan_json_array(t):
    # One file per 1,000 repositories by size, each holding one array.
    path = t.scratch("meta-json")
    meta = derived.repo_meta(t.spark, t.sf_dir)
    row = F.struct(*meta.columns)
    arrays = meta.groupBy(F.expr("size div 100000").alias("part")).agg(
        F.to_json(F.collect_list(row)).alias("value")
    )
    arrays.repartition("part").write.partitionBy("part").text(path)
    back = readers.scan_json_array(t.spark, f"{path}/part=*", schemas.REPO_META)
    return back.selectExpr("* except (license)", "license.spdx_id as spdx_id")


@query("cache_json", sql("SELECT * FROM repo_meta", "repo_meta"))
def cache_json(t):
    path = t.scratch("meta-cache")
    meta = derived.repo_meta(t.spark, t.sf_dir)
    readers.cache_json(meta, path, schemas.REPO_META)
    # The second call finds the copy and leaves it as it is.
    kept = readers.cache_json(meta.limit(0), path, schemas.REPO_META)
    return kept.selectExpr("* except (license)", "license.spdx_id as spdx_id")


PAIR_TEXT = """SELECT * REPLACE (format('{:.2f}', time_diff_hours) AS time_diff_hours,
    format('{:.1f}', time_diff_days) AS time_diff_days,
    substr(test_commit, 1, 8) AS test_commit, substr(prod_commit, 1, 8) AS prod_commit) FROM pairs_table"""


@query("write_pairs", sql(PAIR_TEXT, "pairs_table"))
def write_pairs(t):
    path = t.scratch("pairs-out")
    writers.write_csv(writers.pairs_text(t.pairs), path)
    text = schemas.PAIRS.replace("time_diff_hours double", "time_diff_hours string").replace(
        "time_diff_days double", "time_diff_days string"
    )
    return without_zone(readers.scan_csv(t.spark, path, text), "test_date", "prod_date")


PERCENTS = ("test_first", "same_commit", "prod_first")


@query(
    "write_summary",
    sql(
        "SELECT repo AS repository, total_commits, test_files_added, test_helpers, "
        "prod_files_added, matched_pairs, multi_test_prods, test_first_count, "
        "same_commit_count, prod_first_count, unmatched_test_files, unmatched_prod_files, "
        + ", ".join(f"""format('{{:.1f}}', {p}_pct) AS "{p}_%" """ for p in PERCENTS)
        + """, format('{:.1f}', match_rate_pct) AS "match_rate_%" FROM summary""",
        "summary",
    ),
)
def write_summary(t):
    text = writers.summary_text(t.summary)
    path = t.scratch("summary-out")
    writers.write_csv(text, path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in text.schema)
    return readers.scan_csv(t.spark, path, schema)


@query(
    "write_unmatched",
    sql("""SELECT repo AS repository, test_file, test_class,
      array_to_string(candidates_tried, '|') AS candidates_tried,
      coalesce(original_path, '') AS original_filepath, substr(commit_hash, 1, 8) AS commit_hash,
      commit_date, author, is_helper FROM unmatched""", "unmatched"),
)
def write_unmatched(t):
    path = t.scratch("unmatched-out")
    writers.write_csv(writers.unmatched_text(t.analysis.unmatched), path)
    schema = """repository string, test_file string, test_class string,
        candidates_tried string, original_filepath string, commit_hash string,
        commit_date timestamp, author string, is_helper boolean"""
    back = readers.scan_csv(t.spark, path, schema).na.fill(
        "", ["candidates_tried", "original_filepath"]
    )
    return without_zone(back, "commit_date")


@query(
    "write_report_json",
    sql("""SELECT repo, matched_pairs, unmatched_test_files,
      unmatched_test_files > 100 AS truncated, coalesce(shown, 0) AS shown,
      coalesce(tests, []) AS tests FROM summary LEFT JOIN (
        SELECT repo, least(count(*), 100) AS shown,
               list(test_file ORDER BY test_file)[1:100] AS tests
        FROM unmatched GROUP BY repo) USING (repo)""", "summary", "unmatched"),
)
def write_report_json(t):
    path = t.scratch("report-out")
    rows = writers.report_rows(t.summary, t.analysis.unmatched)
    writers.write_json(rows, path)
    back = t.spark.read.schema(rows.schema).json(path)
    return back.select(
        "repo",
        "matched_pairs",
        "unmatched_test_files",
        F.col("unmatched_tests_truncated").alias("truncated"),
        F.size("unmatched_tests_details").cast("bigint").alias("shown"),
        F.col("unmatched_tests_details.test_file").alias("tests"),
    )


@query(
    "write_report_totals",
    sql("""SELECT count(*) AS total_repositories, count(*) AS successfully_analyzed,
      CAST(sum(total_commits) AS BIGINT) AS commits, CAST(sum(matched_pairs) AS BIGINT) AS pairs,
      CAST(sum(test_first_count) AS BIGINT) AS test_first, round(100 * sum(same_commit_count) / sum(matched_pairs), 6) AS same_commit_pct
      FROM summary""", "summary"),
)
def write_report_totals(t):
    path = t.scratch("report-totals")
    totals = writers.report_totals(t.analysis.report)
    writers.write_json(totals, path)
    back = t.spark.read.schema(totals.schema).json(path)
    sums = F.col("aggregate_statistics")
    return back.select(
        "total_repositories",
        "successfully_analyzed",
        sums["total_commits_analyzed"].alias("commits"),
        sums["total_matched_pairs"].alias("pairs"),
        sums["total_test_first"].alias("test_first"),
        F.round(sums["same_commit_percentage"], 6).alias("same_commit_pct"),
    )


@query(
    "write_report_pairs",
    sql("""SELECT repo, test_file, prod_file, match_method, test_original_file,
      prod_deletion_commit, time_diff_hours FROM pairs""", "pairs"),
)
def write_report_pairs(t):
    path = t.scratch("report-pairs")
    writers.write_json(t.pairs, path)
    back = t.spark.read.schema(t.pairs.schema).json(path)
    return back.select(
        "repo", "test_file", "prod_file", "match_method", "test_original_file",
        "prod_deletion_commit", "time_diff_hours",
    )


ADJUSTED_PAIRS = sql("""SELECT repository, test_file, prod_file, classification, same_commit_is_outlier,
      classification_adj, substr(test_commit, 1, 8) AS test_commit FROM adjusted""", "adjusted")


def adjusted_folder(t) -> str:
    folder = t.scratch("adjusted-out")
    a = t.adjustment
    writers.write_adjusted(folder, t.commits_table, a.pairs, a.audit, a.outliers)
    return folder


@query("write_adjusted", ADJUSTED_PAIRS)
def write_adjusted(t):
    schema = schemas.PAIRS + ", same_commit_is_outlier boolean, classification_adj string"
    return readers.scan_csv(t.spark, f"{adjusted_folder(t)}/pairs", schema).select(
        "repository", "test_file", "prod_file", "classification", "same_commit_is_outlier",
        "classification_adj", "test_commit",
    )


@query(
    "write_adjusted_outliers",
    sql("""SELECT 'outlier' AS part, repository, substr(commit_hash, 1, 8) AS commit_hash,
        total_lines_added::DOUBLE AS lines, total_files_count::DOUBLE AS files, out_due_to_lines AS by_lines FROM outliers
      UNION ALL SELECT 'commit', repository, substr(commit_hash, 1, 8), total_lines_added::DOUBLE,
        total_files_count::DOUBLE, NULL FROM commits_table""", "flagged"),
)
def write_adjusted_outliers(t):
    folder = adjusted_folder(t)
    outliers = readers.scan_csv(
        t.spark, f"{folder}/outlier_commits",
        """repository string, commit_hash string, total_lines_added double, total_files_count double,
           out_due_to_lines boolean, out_due_to_files boolean, thr_lines double, thr_files double""",
    )
    commits = readers.scan_csv(t.spark, f"{folder}/commits", schemas.COMMITS)

    def rows(df, part, by_lines):
        return df.select(
            F.lit(part).alias("part"), "repository", "commit_hash", F.col("total_lines_added").cast("double").alias("lines"),
            F.col("total_files_count").cast("double").alias("files"), by_lines.alias("by_lines"),
        )

    flags = F.col("out_due_to_lines")
    return rows(outliers, "outlier", flags).unionByName(rows(commits, "commit", F.lit(None).cast("boolean")))


CANDIDATE_COLUMNS = """repo, test_ratio, test_files, java_files, num_commits, stars, has_ci_system,
    has_build_system, main_language, forks, first_commit_date, last_commit_date, project_life_days"""
SPAN = ("first_commit_date", "last_commit_date")


@query("write_candidates", sql(f"SELECT {CANDIDATE_COLUMNS} FROM candidates", "candidates"))
def write_candidates(t):
    path = t.scratch("candidates-out")
    writers.write_csv(t.candidates, path)
    return without_zone(readers.scan_csv_by_name(t.spark, [path], schemas.CANDIDATES), *SPAN)


@query(
    "write_missing",
    sql(f"""SELECT {CANDIDATE_COLUMNS} FROM candidates
      WHERE repo NOT IN (SELECT repo FROM shortlist)""", "candidates"),
)
def write_missing(t):
    path = t.scratch("missing-out")
    writers.write_csv(
        funnel.missing_rows(t.candidates, funnel.filter_final(t.candidates)), path
    )
    return without_zone(readers.scan_csv_by_name(t.spark, [path], schemas.CANDIDATES), *SPAN)


@query(
    "write_chunks",
    sql(f"""SELECT {CANDIDATE_COLUMNS}, CAST((row_number() OVER (ORDER BY test_ratio DESC, repo) - 1)
        // CAST(ceil((SELECT count(*) FROM shortlist) / 5) AS BIGINT) + 1 AS INTEGER) AS part
      FROM shortlist""", "candidates"),
)
def write_chunks(t):
    path = t.scratch("chunks-out")
    listed = shortlist.shortlist(t.candidates).withColumn("_down", -F.col("test_ratio"))
    parts = funnel.chunks(listed, ["_down", "repo"]).drop("_down")
    writers.write_chunks(parts, path)
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in parts.schema if f.name != "part"]
    schema = ", ".join([*columns, "part int"])
    return readers.scan_csv(t.spark, path, schema)


@query("scan_partitioned_csvs", sql(f"SELECT {CANDIDATE_COLUMNS} FROM candidates", "candidates"))
def scan_partitioned_csvs(t):
    # Parts with two column orders, as written at different times.
    folder = t.scratch("parts")
    good = funnel.filter_final(t.candidates)
    writers.write_csv(good, f"{folder}/part1")
    missing = funnel.missing_rows(t.candidates, good)
    writers.write_csv(missing.select(*reversed(missing.columns)), f"{folder}/part2")
    both = readers.scan_csv_by_name(
        t.spark, [f"{folder}/part1", f"{folder}/part2"], schemas.CANDIDATES
    )
    return without_zone(both, *SPAN)


@query(
    "write_combined",
    """SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
       UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier""",
)
def write_combined(t):
    customers = t.given("customer").selectExpr(
        "c_name as name", "c_acctbal as balance", "c_mktsegment as segment"
    )
    suppliers = t.given("supplier").selectExpr("s_acctbal as balance", "s_name as name")
    return through_csv(
        t, funnel.combine([customers, suppliers]), "name string, balance double, segment string",
        "combined-out",
    )


@query(
    "write_categories",
    f"""SELECT doc_id, source AS project, {category_sql("(source || ' ' || text)")} AS category,
          nullif(substr(text, 1, 50), '') AS description_snippet
        FROM documents""",
)
def write_categories(t):
    meta = t.given("documents").selectExpr(
        "doc_id", "source as name", "text as description", "'Java' as language"
    )
    path = t.scratch("categories-out")
    writers.write_csv(funnel.categorize(meta, keep=["doc_id"]), path)
    rows, _ = readers.scan_csv_checked(
        t.spark, path, "doc_id bigint, project string, category string, description_snippet string"
    )
    return rows


@query("write_size_stats", sql(mean_median_sql("true"), "adjusted"))
def write_size_stats(t):
    table = stats.size_mean_median(t.adjustment.pairs)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    return through_csv(t, table, schema, "sizes-out")


