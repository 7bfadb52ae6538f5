"""A history stored by repository: buckets of repositories, sorted inside.

Scans of some repositories read the buckets these hash to and, within sorted
files, the row groups that can hold them; scans of a time span skip row groups by
the order of commits.  A large repository fills many files of its bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "repo_bucket"
BUCKETS = 64


def bucket_of(repo: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(repo), F.lit(buckets)).cast("int")


def write_history(changes: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "errorifexists") -> None:
    """``changes`` under ``path``, a folder per bucket, rows sorted by repository and order.

    Ranges of (bucket, repository, order) are even however large a repository
    is, so a task writes few buckets and a hot repository many files.
    """
    slices = int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = (BUCKET, "repo", "commit_seq", "change_seq")
    (
        changes.withColumn(BUCKET, bucket_of(F.col("repo"), buckets))
        .repartitionByRange(slices, *order)
        .sortWithinPartitions(*order)
        .write.mode(mode)
        .partitionBy(BUCKET)
        .parquet(path)
    )


def read_history(
    spark: SparkSession, path: str, repos: list[str] | None = None, since=None, to=None, buckets: int = BUCKETS
) -> DataFrame:
    """The stored changes, or those of some repositories and dates; ``buckets`` as written."""
    changes = spark.read.parquet(path)
    if repos is not None:
        # Both filters are literals once folded: the first picks folders, the second row groups.
        changes = changes.where(F.col(BUCKET).isin(*[bucket_of(F.lit(r), buckets) for r in repos])).where(F.col("repo").isin(*repos))
    if since is not None:
        changes = changes.where(F.col("commit_date") >= F.lit(since).cast("timestamp"))
    if to is not None:
        changes = changes.where(F.col("commit_date") <= F.lit(to).cast("timestamp"))
    return changes.drop(BUCKET)


def one_repository(table: DataFrame, repo: str, column: str = "repository") -> DataFrame:
    """Rows of one repository; one that the table doesn't know is an error."""
    found = table.where(F.col(column) == repo)
    if found.isEmpty():
        raise ValueError(f"no data for repository {repo!r}")
    return found
