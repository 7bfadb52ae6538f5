"""Written tables: column order, short hashes, number formats.

The ``*_table`` functions give the rows as they are written; ``write_*`` put
them into a folder of CSV or JSON Lines files.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.functions.values import fixed_point
from commitlens.operators.ranking import first_per_key

if TYPE_CHECKING:
    from commitlens.plans.mining import Analysis

SHORT_HASH = 8
MOST_UNMATCHED = 100


def short(column: str) -> Column:
    return F.substring(column, 1, SHORT_HASH)


def short_hashes(table: DataFrame) -> DataFrame:
    """A table as it is written: its commit hashes cut for the reader's eye.

    Only text outputs are cut.  Joins and groups use whole hashes, as short
    ones collide within a large repository.
    """
    cut = [c for c in ("commit_hash", "test_commit", "prod_commit") if c in table.columns]
    return table.withColumns({c: short(c) for c in cut})


def commits_table(stats: DataFrame) -> DataFrame:
    return stats.select(
        F.col("repo").alias("repository"),
        "commit_hash",
        "commit_date",
        "author",
        F.col("total_lines").alias("total_lines_added"),
        F.col("files_count").alias("total_files_count"),
        "java_files_count",
    )


SIZES = ("file_lines", "commit_total_lines", "commit_files", "commit_java_files")


def pairs_table(pairs: DataFrame) -> DataFrame:
    """Pairs with hashes and numbers as they are; the input of adjust."""
    both = [f"{side}_{c}" for c in ("file", "class") for side in ("test", "prod")]
    return pairs.select(
        F.col("repo").alias("repository"),
        "classification",
        *both,
        "test_commit",
        "prod_commit",
        *[f"{side}_{c}" for c in ("date", "author") for side in ("test", "prod")],
        "time_diff_hours",
        (F.col("time_diff_hours") / 24).alias("time_diff_days"),
        *[f"{side}_{c}" for side in ("test", "prod") for c in SIZES],
        "pair_status",
    )


def pairs_text(pairs: DataFrame) -> DataFrame:
    """Pairs as written: short hashes, hours with two digits, days with one."""
    return short_hashes(pairs_table(pairs)).withColumns(
        {
            "time_diff_hours": fixed_point(F.col("time_diff_hours"), 2),
            "time_diff_days": fixed_point(F.col("time_diff_days"), 1),
        }
    )


def summary_text(summary: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Summary as written: percentages with one digit, ``%`` in the names.

    A failed repository is a row of its name, ``ERROR`` and the error, as text;
    its other columns are empty.
    """
    text = summary.select(
        F.col("repo").alias("repository"),
        "total_commits",
        "test_files_added",
        "test_helpers",
        "prod_files_added",
        "matched_pairs",
        "multi_test_prods",
        "test_first_count",
        "same_commit_count",
        "prod_first_count",
        *[
            fixed_point(F.col(f"{k}_pct"), 1).alias(f"{k}_%")
            for k in ("test_first", "same_commit", "prod_first")
        ],
        "unmatched_test_files",
        "unmatched_prod_files",
        fixed_point(F.col("match_rate_pct"), 1).alias("match_rate_%"),
    )
    if failed is None:
        return text
    errors = failed.select(
        F.col("repo").alias("repository"), F.lit("ERROR").alias("total_commits"), F.col("error").alias("test_files_added")
    )
    as_text = text.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in text.columns])
    return as_text.unionByName(errors, allowMissingColumns=True)


def unmatched_text(unmatched: DataFrame) -> DataFrame:
    return unmatched.select(
        F.col("repo").alias("repository"),
        "test_file",
        "test_class",
        F.array_join("candidates_tried", "|").alias("candidates_tried"),
        F.coalesce("original_path", F.lit("")).alias("original_filepath"),
        F.coalesce(short("commit_hash"), F.lit("")).alias("commit_hash"),
        "commit_date",
        "author",
        "is_helper",
    )


DETAILS = """array<struct<test_file:string,test_class:string,class_names:array<string>,
    candidates_tried:array<string>,reason:string,original_path:string,commit_hash:string,
    commit_date:timestamp,author:string,is_helper:boolean>>"""


def report_rows(
    summary: DataFrame, unmatched: DataFrame | None = None, most: int = MOST_UNMATCHED
) -> DataFrame:
    """One document per repository: its counters and first ``most`` unmatched tests.

    The number bounds a document however large the repository; all unmatched
    tests and the pairs are tables of their own.  Without ``unmatched`` the
    list is empty.
    """
    cut_off = (F.col("unmatched_test_files") > most).alias("unmatched_tests_truncated")
    if unmatched is None:
        none = F.array().cast(DETAILS).alias("unmatched_tests_details")
        return summary.select(*summary.columns, none, F.lit(False).alias("unmatched_tests_truncated"))
    details = F.struct(
        "test_file", "test_class", "class_names", "candidates_tried", "reason",
        "original_path", "commit_hash", "commit_date", "author", "is_helper",
    )
    nested = (
        first_per_key(unmatched, ["repo"], [F.col("test_file")], most)
        .groupBy("repo")
        .agg(F.array_sort(F.collect_list(details)).alias("unmatched_tests_details"))
    )
    return summary.join(nested, "repo", "left").select(
        *summary.columns,
        F.coalesce(
            "unmatched_tests_details", F.array().cast(nested.schema[1].dataType)
        ).alias("unmatched_tests_details"),
        cut_off,
    )


AGGREGATES = {
    "total_commits_analyzed": "total_commits",
    "total_test_files_added": "test_files_added",
    "total_test_helpers": "test_helpers",
    "total_prod_files_added": "prod_files_added",
    "total_matched_pairs": "matched_pairs",
    "total_multi_test_prods": "multi_test_prods",
    "total_test_first": "test_first_count",
    "total_same_commit": "same_commit_count",
    "total_production_first": "prod_first_count",
    "test_first_percentage": "test_first_pct",
    "same_commit_percentage": "same_commit_pct",
    "production_first_percentage": "prod_first_pct",
}


def report_totals(totals: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """The one document over all repositories: how many there are, how many were analyzed, their sums and shares.

    ``totals`` are the rows of a summary with the totals (null ``repo``).  With
    nothing analyzed there are no sums.
    """
    found = totals.where("repo is null").select(
        F.col("repositories"), F.struct(*[F.col(c).alias(n) for n, c in AGGREGATES.items()]).alias("aggregate_statistics")
    )
    lost = failed if failed is not None else totals.limit(0)
    lost = lost.select(F.lit(0).cast("long").alias("repositories"), F.lit(1).cast("long").alias("failed"))
    both = found.withColumn("failed", F.lit(0).cast("long")).unionByName(lost, allowMissingColumns=True)
    good = F.coalesce(F.sum("repositories"), F.lit(0))
    return both.agg(
        (good + F.coalesce(F.sum("failed"), F.lit(0))).alias("total_repositories"),
        good.alias("successfully_analyzed"),
        F.first("aggregate_statistics", ignorenulls=True).alias("aggregate_statistics"),
    )


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    (
        df.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_chunks(parts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per part; parts without rows get none."""
    parts.write.mode(mode).partitionBy("part").option("header", True).option(
        "escape", '"'
    ).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_analysis(
    folder: str, analysis: Analysis, with_unmatched: bool = True, most_unmatched: int = MOST_UNMATCHED
) -> None:
    """All outputs of one analysis; the table of unmatched tests may be left out, reports never are."""
    unmatched = analysis.unmatched if with_unmatched else None
    write_csv(pairs_text(analysis.pairs), f"{folder}/pairs")
    write_csv(summary_text(analysis.summary, analysis.failed), f"{folder}/summary")
    write_csv(short_hashes(commits_table(analysis.commits)), f"{folder}/commits")
    write_json(analysis.pairs, f"{folder}/report_pairs")
    write_json(report_rows(analysis.summary, unmatched, most_unmatched), f"{folder}/report")
    write_json(report_totals(analysis.report, analysis.failed), f"{folder}/report_totals")
    write_csv(analysis.failed, f"{folder}/failed")
    if unmatched is not None:
        write_csv(unmatched_text(unmatched), f"{folder}/unmatched")


def write_adjusted(
    folder: str, commits: DataFrame, adjusted: DataFrame, audit: DataFrame, outliers: DataFrame
) -> None:
    """Adjusted artefacts; outlier commits only where there are any."""
    write_csv(short_hashes(commits), f"{folder}/commits")
    write_csv(short_hashes(adjusted), f"{folder}/pairs")
    write_csv(
        audit.orderBy(
            F.desc("same_commit_pairs_relabeled_fraction"), F.desc("same_commit_pairs")
        ),
        f"{folder}/squash_like_summary",
    )
    if not outliers.isEmpty():
        write_csv(short_hashes(outliers), f"{folder}/outlier_commits")
