"""From repository metadata to the shortlist worth mining."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.functions import fixed, paths
from commitlens.functions.values import category, full_text, whole_days_between
from commitlens.operators.ranking import number_rows
from commitlens.session import cut

SHORTLIST_ORDER = (
    "repo", "test_ratio", "test_files", "java_files", "num_commits", "stars",
    "has_ci_system", "has_build_system",
)


def repo_commit_span(commits: DataFrame) -> DataFrame:
    """Commits of each repository and its first and last one, by date and hash.

    Commits are numbered in that order, so that the first and last of a
    repository are the extremes of a number, found by hash aggregation.
    """
    aged = number_rows(
        commits.select("repo", "commit_date", "commit_hash", "author"), [], ["commit_date", "commit_hash", "repo"], "_age"
    )
    aged = cut(aged, "ages")
    spans = aged.groupBy("repo").agg(
        F.count("*").alias("num_commits"),
        F.min("commit_date").alias("first_commit_date"),
        F.max("commit_date").alias("last_commit_date"),
        F.min("_age").alias("_first"),
        F.max("_age").alias("_last"),
    )
    for end in ("first", "last"):
        named = aged.select(
            F.col("_age").alias(f"_{end}"), F.col("commit_hash").alias(f"{end}_commit"), F.col("author").alias(f"{end}_author")
        )
        spans = spans.join(named, f"_{end}")
    return spans.select(
        "repo", "num_commits", "first_commit_date", "last_commit_date", "first_commit", "last_commit", "first_author", "last_author"
    )


def project_life_days(stats: DataFrame) -> DataFrame:
    days = whole_days_between(F.col("first_commit_date"), F.col("last_commit_date"))
    return stats.withColumn("project_life_days", days.cast("double"))


def repo_stats(meta: DataFrame, spans: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Metadata with commit count and span.

    An empty repository has 0 commits and no dates; one whose lookup
    ``failed`` has no count either.
    """
    stats = meta.select(
        F.col("name").alias("repo"),
        F.col("language").alias("main_language"),
        F.col("stargazers_count").alias("stars"),
        F.col("forks_count").alias("forks"),
    ).join(
        spans.select("repo", "num_commits", "first_commit_date", "last_commit_date"),
        "repo",
        "left",
    )
    count = F.coalesce("num_commits", F.lit(0))
    if failed is not None:
        lost = failed.select("repo").distinct().withColumn("_lost", F.lit(True))
        stats = stats.join(lost, "repo", "left")
        count = F.when(F.col("_lost").isNull(), count)
    return project_life_days(
        stats.withColumn("num_commits", count.cast("double")).drop("_lost")
    )


def filter_mature(stats: DataFrame, language: str = "Java") -> DataFrame:
    return stats.where(
        (F.col("main_language") == language)
        & (F.col("num_commits") > fixed.MIN_COMMITS)
        & (F.col("project_life_days") > fixed.MIN_LIFE_DAYS)
    )


def filter_final(candidates: DataFrame, min_java_files: int = fixed.MIN_JAVA_FILES) -> DataFrame:
    return candidates.where(
        (F.col("has_build_system") | F.col("has_ci_system"))
        & (F.col("java_files") > min_java_files)
    )


def filter_repo_meta(
    meta: DataFrame,
    language: str | None = None,
    min_size: int | None = None,
    max_size: int | None = None,
    require_apache_license: bool = True,
    exclude_forks: bool = True,
    exclude_archived: bool = True,
) -> DataFrame:
    size = F.coalesce("size", F.lit(0))
    if exclude_forks:
        meta = meta.where(~F.coalesce("fork", F.lit(False)))
    if exclude_archived:
        meta = meta.where(~F.coalesce("archived", F.lit(False)))
    if language is not None:
        meta = meta.where(F.col("language") == language)
    if min_size is not None:
        meta = meta.where(size >= min_size)
    if max_size is not None:
        meta = meta.where(size <= max_size)
    if require_apache_license:
        meta = meta.where(F.col("license.spdx_id") == "Apache-2.0")
    return meta


def tree_counts(tree: DataFrame) -> DataFrame:
    java = paths.tree_java_file(F.col("path"), F.col("type"))
    counts = tree.groupBy("repo").agg(
        F.count_if(java).alias("java_files"),
        F.count_if(java & paths.tree_test_file(F.col("path"))).alias("test_files"),
    )
    share = F.round(F.col("test_files") / F.col("java_files"), 4)
    return counts.withColumn("test_ratio", F.when(F.col("java_files") > 0, share).otherwise(0.0))


def root_flags(tree: DataFrame) -> DataFrame:
    """Build and CI systems seen at the root of each repository."""
    at_root = ~F.col("path").contains("/")

    def seen(files) -> Column:
        return F.bool_or(at_root & F.col("path").isin(*files))

    return tree.groupBy("repo").agg(
        seen(fixed.BUILD_FILES).alias("has_build_system"),
        seen(fixed.CI_FILES).alias("has_ci_system"),
    )


def has_test_dir(tree: DataFrame, max_depth: int = 2) -> DataFrame:
    """Whether a directory near the root is named after tests."""
    near = (F.col("type") == "dir") & (F.size(F.split("path", "/")) <= max_depth + 1)
    named = F.lower(paths.basename(F.col("path"))).contains("test")
    return tree.groupBy("repo").agg(F.bool_or(near & named).alias("has_test_dir"))


def with_structure(stats: DataFrame, tree: DataFrame) -> DataFrame:
    """Repository rows with their tree counts and flags, 0 and false if unseen."""
    defaults = {
        "java_files": 0,
        "test_files": 0,
        "test_ratio": 0.0,
        "has_build_system": False,
        "has_ci_system": False,
    }
    joined = stats.join(tree_counts(tree), "repo", "left").join(root_flags(tree), "repo", "left")
    return joined.na.fill(defaults)


def reorder(df: DataFrame, first: tuple[str, ...] = SHORTLIST_ORDER) -> DataFrame:
    return df.select(*first, *[c for c in df.columns if c not in first])


def sort_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy(F.desc("test_ratio"), "repo")


def chunks(df: DataFrame, order: list[str], parts: int = fixed.SHORTLIST_PARTS) -> DataFrame:
    """Consecutive parts of ceil(n / parts) rows; only the last is shorter."""
    numbered = number_rows(df, [], order, "_n", total="_total")
    size = F.ceil(F.col("_total") / F.lit(parts))
    return numbered.withColumn("part", F.floor((F.col("_n") - 1) / size) + 1).drop("_n", "_total")


def combine(parts: list[DataFrame]) -> DataFrame:
    """All rows by column name; a column a part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def missing_rows(original: DataFrame, parts: DataFrame, key: str = "repo") -> DataFrame:
    return original.join(parts.select(key).distinct(), key, "left_anti")


def top_n(df: DataFrame, column: str, n: int = 10, tie: str = "repo") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(column), tie).limit(n)


def categorize(
    meta: DataFrame,
    keywords=None,
    language: str | None = "Java",
    keep: list[str] | None = None,
) -> DataFrame:
    """Keyword category of each repository and a snippet of its description."""
    kept = meta if language is None else meta.where(F.col("language") == language)
    return kept.select(
        *(keep or []),
        F.col("name").alias("project"),
        category(full_text(F.col("name"), F.col("description")), keywords).alias("category"),
        F.substring(F.coalesce("description", F.lit("")), 1, 50).alias("description_snippet"),
    )


def category_lookup(
    projects: DataFrame, meta: DataFrame, order: str, keywords=None, name_column: str = "repo"
) -> DataFrame:
    """Category of each project by name; of equal names the last by ``order``."""
    last = (
        meta.where(F.col("name").isNotNull())
        .groupBy("name")
        .agg(F.max_by("description", order).alias("description"))
    )
    found = last.select(
        F.col("name").alias(name_column),
        category(full_text(F.col("name"), F.col("description")), keywords).alias("category"),
    )
    return projects.join(found, name_column, "left")
