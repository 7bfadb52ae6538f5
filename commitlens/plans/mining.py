"""File changes to files, pairs, unmatched tests and summaries."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.functions import names
from commitlens.functions.values import percent
from commitlens.operators import history, matching, validation
from commitlens.session import cut

COUNTERS = (
    "total_commits", "test_files_added", "test_helpers", "prod_files_added",
    "matched_pairs", "multi_test_prods", "test_first_count", "same_commit_count",
    "prod_first_count", "unmatched_test_files", "unmatched_prod_files",
    "active_pairs", "deleted_pairs", "test_deleted_pairs", "prod_deleted_pairs",
    "both_deleted_pairs",
)


@dataclass
class Analysis:
    """Tables of one analysis, each written once."""

    commits: DataFrame
    files: DataFrame
    matches: DataFrame
    failed: DataFrame

    @cached_property
    def pairs(self) -> DataFrame:
        return cut(matching.make_pairs(self.files, self.matches), "pairs")

    @cached_property
    def unmatched(self) -> DataFrame:
        return cut(matching.unmatched_tests(self.files, self.matches), "unmatched")

    @cached_property
    def summary(self) -> DataFrame:
        return cut(repo_summary(self.commits, self.files, self.pairs), "summary")

    @cached_property
    def report(self) -> DataFrame:
        """The rows of ``summary`` and, with a null ``repo``, their totals."""
        return report_rows(self.summary)


def analyze(
    changes: DataFrame,
    terms: DataFrame | list[str] | tuple[str, ...] | None = None,
    repos: list[str] | DataFrame | None = None,
    since=None,
    to=None,
    max_commits: int | None = None,
) -> Analysis:
    """Files, pairs and counters of every repository that can be analyzed.

    ``terms`` are names too general to match on besides the fixed ones (a list,
    or the first column of a table of any size).  The other parameters bound
    the scan.  Changes are written once, good and bad rows apart; a repository
    with a bad row is a row of ``failed`` and takes no part in the rest.
    """
    spark = changes.sparkSession
    changes = history.select_changes(changes, repos, since, to, max_commits)
    good, failed = validation.split_changes(changes)
    commits = cut(history.commit_stats(good), "commits")
    files = cut(history.build_files(good, commits, names.term_table(spark, terms)), "files")
    return Analysis(commits, files, cut(matching.best_matches(files), "matches"), failed)


def repo_summary(commits: DataFrame, files: DataFrame, pairs: DataFrame) -> DataFrame:
    """All counters of a repository; one without files or pairs has zeros."""
    totals = commits.groupBy("repo").agg(F.count("*").alias("total_commits"))
    counted = matching.match_counts(files, pairs).withColumnsRenamed(
        {
            "test_files": "test_files_added",
            "prod_files": "prod_files_added",
            "unmatched_tests": "unmatched_test_files",
            "unmatched_prods": "unmatched_prod_files",
        }
    )
    counters = totals.join(counted, "repo", "left").na.fill(0, list(COUNTERS))
    total = F.col("matched_pairs")
    return counters.select(
        "repo",
        *COUNTERS,
        *shares(total),
        percent(total, F.col("test_files_added") - F.col("test_helpers")).alias(
            "match_rate_pct"
        ),
    )


def shares(total: Column) -> list[Column]:
    return [
        percent(F.col(f"{kind}_count"), total).alias(f"{kind}_pct")
        for kind in ("test_first", "same_commit", "prod_first")
    ]


def global_totals(summary: DataFrame) -> DataFrame:
    """Sums over all repositories and the shares of the three classes."""
    return report_rows(summary).where("repo is null").select("repositories", *COUNTERS, *SHARES)


SHARES = ("test_first_pct", "same_commit_pct", "prod_first_pct")


def report_rows(summary: DataFrame) -> DataFrame:
    """One row per repository and one, with a null ``repo``, for all of them.

    A rollup: rows and totals come from one pass.  ``repositories`` counts the
    repositories of a row, ``analyzed`` those with tests.  An empty summary has
    no totals.
    """
    totals = summary.rollup("repo").agg(
        F.count("*").alias("repositories"),
        F.count_if(F.col("test_files_added") > 0).alias("analyzed"),
        *[F.sum(c).alias(c) for c in COUNTERS],
    )
    matched = F.col("matched_pairs")
    rate = percent(matched, F.col("test_files_added") - F.col("test_helpers"))
    return totals.select("repo", "repositories", "analyzed", *COUNTERS, *shares(matched), rate.alias("match_rate_pct"))
