"""Which repositories can be analyzed, and why others can't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from commitlens.session import cut, observed

#: What a single change may lack, worst first.
LACKS = (
    ("commit_hash", "a change has no commit hash"),
    ("commit_seq", "a change has no place among the commits"),
    ("change_seq", "a change has no place in its commit"),
    ("commit_date", "a change has no date"),
)
TWO_AUTHORS = "a commit has two authors"
REASONS = (*(text for _, text in LACKS), TWO_AUTHORS)


def _fault() -> Column:
    """Number of the first thing a change lacks, else null."""
    faults = [F.when(F.col(name).isNull(), F.lit(i)) for i, (name, _) in enumerate(LACKS)]
    return F.coalesce(*faults)


def failed_repositories(changes: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(repo, error, rows) of the repositories with a fault, and the numbers of rows and of faulty rows.

    ``error`` is the worst fault, ``rows`` how many rows (or commits with two
    authors) have one.  One pass over narrow columns, counted while it runs.
    """
    seen = Observation()
    checked = changes.select("repo", "commit_hash", "author", _fault().alias("_fault")).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count("_fault").alias("faulty")
    )
    # Rows of a commit that agree are one before anything is shuffled.
    grouped = checked.groupBy("repo", "commit_hash", F.coalesce("author", F.lit("Unknown")).alias("author"), "_fault").agg(
        F.count("*").alias("rows")
    )
    grouped = cut(grouped, "checked")
    authors = (
        grouped.where(F.col("commit_hash").isNotNull())
        .select("repo", "commit_hash", "author")
        .distinct()
        .groupBy("repo", "commit_hash")
        .agg(F.count("*").alias("authors"))
        .where("authors > 1")
        .select("repo", F.lit(len(LACKS)).alias("_fault"), F.lit(1).cast("long").alias("rows"))
    )
    faults = grouped.where(F.col("_fault").isNotNull()).select("repo", "_fault", "rows").unionByName(authors)
    error = F.element_at(F.array(*map(F.lit, REASONS)), F.col("_fault") + 1)
    failed = faults.groupBy("repo").agg(F.min("_fault").alias("_fault"), F.sum("rows").alias("rows")).select(
        "repo", error.alias("error"), "rows"
    )
    return cut(failed, "failed"), observed(seen, "rows", "faulty")


def split_changes(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes of sound repositories, and the failed ones; rows without a repository belong to none."""
    failed, _ = failed_repositories(changes)
    good = changes.where(F.col("repo").isNotNull())
    if failed.isEmpty():
        return good, failed
    return good.join(failed.select("repo"), "repo", "left_anti"), failed
