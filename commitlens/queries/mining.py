"""Queries on the mined history: events, renames, files, matches, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from commitlens.functions import names
from commitlens.operators import history, matching, validation
from commitlens.plans import mining
from commitlens.queries.oracle import sql
from commitlens.queries.registry import query
from commitlens.sources import layout, writers

WINDOW = ("1996-01-01", "1999-12-31")
FIRST_COMMITS = 100

EVENT_COLUMNS = (
    "repo, commit_seq, change_seq, commit_hash, commit_date, author, type, path, old_path, lines"
)


@query(
    "scan_file_changes",
    sql(
        f"""SELECT * FROM file_changes
        WHERE commit_date BETWEEN TIMESTAMP '{WINDOW[0]}' AND TIMESTAMP '{WINDOW[1]}'""",
        "file_changes",
    ),
)
def scan_file_changes(t):
    return history.select_changes(t.changes, since=WINDOW[0], to=WINDOW[1])


@query(
    "first_n_commits",
    sql(
        f"""SELECT repo, commit_hash, commit_seq FROM (
          SELECT DISTINCT repo, commit_hash, commit_seq,
                 dense_rank() OVER (PARTITION BY repo ORDER BY commit_seq) AS r
          FROM file_changes) WHERE r <= {FIRST_COMMITS}""",
        "file_changes",
    ),
)
def first_n_commits(t):
    return history.first_n_commits(t.changes, FIRST_COMMITS)


@query(
    "filter_repo_list",
    sql(
        """SELECT repo, count(*) AS changes FROM file_changes
        WHERE repo IN (SELECT 'repo_' || n_nationkey FROM nation WHERE n_regionkey IN (1, 3))
        GROUP BY repo""",
        "file_changes",
    ),
)
def filter_repo_list(t):
    listed = (
        t.given("nation")
        .where("n_regionkey in (1, 3)")
        .select(F.concat(F.lit("repo_"), "n_nationkey").alias("repo"))
    )
    kept = history.select_changes(t.changes, repos=listed)
    return kept.groupBy("repo").agg(F.count("*").alias("changes"))


@query("commit_stats", sql("SELECT * FROM commit_stats", "commit_stats"))
def commit_stats(t):
    return history.commit_stats(t.changes)


@query("file_events", sql(f"SELECT {EVENT_COLUMNS} FROM file_events", "file_events"))
def file_events(t):
    return history.file_events(t.changes)


@query(
    "file_timeline",
    sql(
        """SELECT repo, path, commit_seq, change_seq, type, commit_hash, commit_date, author, lines
        FROM file_events WHERE type <> 'RENAME'""",
        "file_events",
    ),
)
def file_timeline(t):
    return history.file_timeline(t.events)


@query(
    "effective_addition",
    sql(
        """SELECT repo, path, added.commit_seq AS commit_seq, added.change_seq AS change_seq,
        added.commit_hash AS commit_hash, added.commit_date AS commit_date,
        added.author AS author, added.lines AS lines FROM additions""",
        "additions",
    ),
)
def effective_addition(t):
    return history.effective_additions(t.events)


@query("deletion_info", sql("SELECT * FROM deletions", "deletions"))
def deletion_info(t):
    return history.deletions(t.events, t.forward)


@query(
    "renamed_away_anti",
    sql(
        """SELECT repo, path, commit_hash FROM file_events e WHERE type = 'DELETE'
        AND (repo, path) NOT IN (SELECT (repo, src) FROM forward)""",
        "edges",
    ),
)
def renamed_away_anti(t):
    away = t.forward.select("repo", F.col("src").alias("path"))
    deleted = t.events.where("type = 'DELETE'")
    return deleted.join(away, ["repo", "path"], "left_anti").select("repo", "path", "commit_hash")


@query(
    "rename_last_wins",
    sql(
        """SELECT 'backward' AS direction, * FROM backward
        UNION ALL SELECT 'forward', * FROM forward""",
        "edges",
    ),
)
def rename_last_wins(t):
    back = t.backward.withColumn("direction", F.lit("backward"))
    return back.unionByName(t.forward.withColumn("direction", F.lit("forward")))


@query("rename_original_path", sql("SELECT repo, path, original FROM origins", "origins"))
def rename_original_path(t):
    return history.rename_origins(t.events, t.backward)


@query("starting_paths", sql("SELECT DISTINCT repo, original FROM origins", "origins"))
def starting_paths(t):
    return history.rename_origins(t.events, t.backward).select("repo", "original").distinct()


@query("rename_final_path", sql("SELECT repo, original, final FROM chains", "chains"))
def rename_final_path(t):
    return t.chains.select("repo", "original", "final")


@query("rename_all_paths", sql("SELECT repo, original, all_paths FROM chains", "chains"))
def rename_all_paths(t):
    return t.chains.select("repo", "original", "all_paths")


@query("build_files", sql("SELECT * FROM files", "files"))
def build_files(t):
    return t.files


@query(
    "commit_stats_lookup",
    sql("SELECT repo, path, commit_lines, commit_files, commit_java_files FROM files", "files"),
)
def commit_stats_lookup(t):
    return t.files.select("repo", "path", "commit_lines", "commit_files", "commit_java_files")


@query(
    "order_preserving_dedup",
    sql("SELECT repo, path, class_names, packages, candidates FROM files", "files"),
)
def order_preserving_dedup(t):
    return t.files.select("repo", "path", "class_names", "packages", "candidates")


@query(
    "set_union_terms",
    sql(
        """SELECT class_name, class_name IN (SELECT word FROM generic) AS is_generic, count(*) AS files
        FROM files GROUP BY ALL""",
        "files",
    ),
)
def set_union_terms(t):
    classes = t.files.groupBy("class_name").agg(F.count("*").alias("files"))
    return names.is_generic(classes, "class_name", t.terms)


# Rows that a broken history may hold, by the keys of their orders.
BROKEN = {
    "commit_hash": "repo = 'repo_3' AND commit_seq % 11 = 0",
    "change_seq": "repo IN ('repo_3', 'repo_5') AND commit_seq % 7 = 0",
    "commit_date": "repo = 'repo_8' AND added_lines = 13",
}
TWO_NAMES = "repo = 'repo_13' AND added_lines % 2 = 0"


@query(
    "failed_repositories",
    sql(
        f"""SELECT repo, CASE WHEN count(*) FILTER (commit_hash IS NULL) > 0 THEN 'a change has no commit hash'
          WHEN count(*) FILTER (change_seq IS NULL) > 0 THEN 'a change has no place in its commit'
          WHEN count(*) FILTER (commit_date IS NULL) > 0 THEN 'a change has no date'
          ELSE 'a commit has two authors' END AS error,
          count(*) FILTER (commit_hash IS NULL OR change_seq IS NULL OR commit_date IS NULL)
            + count(DISTINCT commit_hash) FILTER (authors > 1) AS rows
        FROM (SELECT *, len(list_distinct(list(author) OVER (PARTITION BY repo, commit_hash))) AS authors FROM (
          SELECT * REPLACE (CASE WHEN NOT ({BROKEN["commit_hash"]}) THEN commit_hash END AS commit_hash,
            CASE WHEN NOT ({BROKEN["change_seq"]}) THEN change_seq END AS change_seq,
            CASE WHEN NOT ({BROKEN["commit_date"]}) THEN commit_date END AS commit_date,
            author || CASE WHEN {TWO_NAMES} THEN '!' ELSE '' END AS author) FROM file_changes))
        WHERE commit_hash IS NULL OR change_seq IS NULL OR commit_date IS NULL OR (commit_hash IS NOT NULL AND authors > 1)
        GROUP BY repo""",
        "file_changes",
    ),
)
def failed_repositories(t):
    lost = {c: F.when(~F.expr(where), F.col(c)) for c, where in BROKEN.items()}
    author = F.when(F.expr(TWO_NAMES), F.concat("author", F.lit("!"))).otherwise(F.col("author"))
    failed, _ = validation.failed_repositories(t.changes.withColumns({**lost, "author": author}))
    return failed


@query(
    "scan_stored_history",
    sql("""SELECT * FROM file_changes WHERE repo IN ('repo_1', 'repo_7')
        AND commit_date >= TIMESTAMP '1997-01-01'""", "file_changes"),
)
def scan_stored_history(t):
    path = t.scratch("history")
    layout.write_history(t.changes, path)
    return layout.read_history(t.spark, path, ["repo_1", "repo_7"], since="1997-01-01")


CANDIDATE_MATCHES = """
SELECT repo, test_file, CAST(rank AS INTEGER) AS candidate_rank, class_name, method,
       prod_file FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, test_file, rank, class_name, method
                               ORDER BY commit_seq, change_seq, prod_file) AS r
  FROM (
    SELECT c.repo, c.path AS test_file, c.rank, c.class_name, p.path AS prod_file,
           p.commit_seq, p.change_seq, unnest(list_filter([
             CASE WHEN list_has_any(t.packages, p.packages) THEN 0 END,
             CASE WHEN list_has_any(t.keys, p.keys) THEN 1 END,
             CASE WHEN c.rank = 0 THEN 2 END], lambda m: m IS NOT NULL)) AS method
    FROM (SELECT repo, path, unnest(candidates) AS class_name,
                 generate_subscripts(candidates, 1) - 1 AS rank
          FROM files WHERE is_test AND NOT is_helper) c
    JOIN offers t ON t.repo = c.repo AND t.path = c.path
    JOIN (SELECT *, unnest(class_names) AS class_name FROM offers WHERE NOT is_test) p
      ON p.repo = c.repo AND p.class_name = c.class_name))
WHERE r = 1"""


def _candidate_matches(t):
    return matching.candidate_matches(t.files)


@query("class_name_index_join", sql(CANDIDATE_MATCHES, "matches"))
def class_name_index_join(t):
    return _candidate_matches(t)


@query("package_overlap", sql(f"SELECT * FROM ({CANDIDATE_MATCHES}) WHERE method = 0", "matches"))
def package_overlap(t):
    return _candidate_matches(t).where(F.col("method") == matching.SAME)


@query("package_similar", sql(f"SELECT * FROM ({CANDIDATE_MATCHES}) WHERE method = 1", "matches"))
def package_similar(t):
    return _candidate_matches(t).where(F.col("method") == matching.SIMILAR)


@query("best_match_join", sql("SELECT repo, test_file, prod_file, match_method FROM matches",
                              "matches"))
def best_match_join(t):
    return t.analysis.matches.select("repo", "test_file", "prod_file", "match_method")


@query("best_match_rank", sql("SELECT * FROM matches", "matches"))
def best_match_rank(t):
    return matching.best_matches(t.files)


@query("test_production_pairs", sql("SELECT * FROM pairs", "pairs"))
def test_production_pairs(t):
    return t.analysis.pairs


@query(
    "classification",
    sql("""SELECT repo, test_file, prod_file, classification, time_diff_hours, pair_status,
        test_was_renamed, prod_was_renamed FROM pairs""", "pairs"),
)
def classification(t):
    return t.pairs.select(
        "repo", "test_file", "prod_file", "classification", "time_diff_hours", "pair_status",
        "test_was_renamed", "prod_was_renamed",
    )


@query("unmatched_tests", sql("SELECT * FROM unmatched", "unmatched"))
def unmatched_tests(t):
    return t.analysis.unmatched


@query(
    "file_inventory_counts",
    sql("""SELECT repo, test_files_added AS test_files, test_helpers,
        prod_files_added AS prod_files, real_tests, deleted_tests, deleted_prods
        FROM inventory""", "summary"),
)
def file_inventory_counts(t):
    return matching.inventory_counts(t.files)


@query(
    "match_counts",
    sql("""SELECT repo, matched_pairs, multi_test_prods,
        unmatched_test_files AS unmatched_tests, unmatched_prod_files AS unmatched_prods
        FROM counters""", "summary"),
)
def match_counts(t):
    return matching.match_counts(t.files, t.pairs).select(
        "repo", "matched_pairs", "multi_test_prods", "unmatched_tests", "unmatched_prods"
    )


@query(
    "classification_counts",
    sql("SELECT repo, test_first_count, same_commit_count, prod_first_count FROM pair_counts",
        "summary"),
)
def classification_counts(t):
    return matching.classification_counts(t.pairs)


@query(
    "pair_status_counts",
    sql("""SELECT repo, active_pairs, test_deleted_pairs, prod_deleted_pairs,
        both_deleted_pairs, deleted_pairs FROM pair_counts""", "summary"),
)
def pair_status_counts(t):
    return matching.pair_status_counts(t.pairs)


@query("repo_summary", sql("SELECT * FROM summary", "summary"))
def repo_summary(t):
    return t.summary


@query(
    "global_totals",
    sql(
        "SELECT count(*) AS repositories, "
        + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in mining.COUNTERS)
        + ", "
        + ", ".join(
            f"CASE WHEN sum(matched_pairs) > 0 THEN CAST(sum({k}_count) AS BIGINT) "
            f"/ CAST(sum(matched_pairs) AS BIGINT) * 100 ELSE 0.0 END AS {k}_pct"
            for k in ("test_first", "same_commit", "prod_first")
        )
        + " FROM summary",
        "summary",
    ),
)
def global_totals(t):
    return mining.global_totals(t.summary)


@query(
    "distinct_values",
    sql("SELECT DISTINCT repository FROM pairs_table ORDER BY 1", "pairs_table"),
)
def distinct_values(t):
    return t.pairs_table.select("repository").distinct().orderBy("repository")


@query(
    "sort_report_views",
    sql("""SELECT repo, total_commits, matched_pairs, multi_test_prods, test_first_count,
        same_commit_count, prod_first_count, test_first_pct FROM summary
        ORDER BY matched_pairs DESC, repo""", "summary"),
)
def sort_report_views(t):
    return t.summary.select(
        "repo", "total_commits", "matched_pairs", "multi_test_prods", "test_first_count",
        "same_commit_count", "prod_first_count", "test_first_pct",
    ).orderBy(F.desc("matched_pairs"), "repo")


@query(
    "truncate_list",
    sql("""SELECT repo, unmatched_test_files > 100 AS truncated,
        coalesce(tests, []) AS tests FROM summary LEFT JOIN (
          SELECT repo, list(test_file ORDER BY test_file)[1:100] AS tests
          FROM unmatched GROUP BY repo) USING (repo)""", "summary", "unmatched"),
)
def truncate_list(t):
    rows = writers.report_rows(t.summary, t.analysis.unmatched)
    return rows.select(
        "repo",
        F.col("unmatched_tests_truncated").alias("truncated"),
        F.col("unmatched_tests_details.test_file").alias("tests"),
    )


@query(
    "first_view_or_purchase",
    """SELECT user_id, CASE WHEN v IS NULL OR p IS NULL THEN NULL WHEN v < p THEN 'VIEW_FIRST'
         ELSE 'PURCHASE_FIRST' END AS first_kind
       FROM (SELECT user_id, min(ts) FILTER (event_type = 'view') AS v,
                    min(ts) FILTER (event_type = 'purchase') AS p
             FROM events GROUP BY user_id)""",
)
def first_view_or_purchase(t):
    def first(kind):
        return F.min(F.when(F.col("event_type") == kind, F.col("ts")))

    firsts = t.given("events").groupBy("user_id").agg(
        first("view").alias("v"), first("purchase").alias("p")
    )
    known = F.col("v").isNotNull() & F.col("p").isNotNull()
    order = F.when(F.col("v") < F.col("p"), "VIEW_FIRST").otherwise("PURCHASE_FIRST")
    return firsts.select("user_id", F.when(known, order).alias("first_kind"))
