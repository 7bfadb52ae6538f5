"""Squash-like commits: outlier sizes, relabelled pairs, audit rows.

Works on ``writers.commits_table`` and ``writers.pairs_table``.  Both hold whole
commit hashes; tables read back from text outputs hold short ones and can be
used as well, as long as both come from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.functions import fixed
from commitlens.functions.values import percent, ratio, to_number_or_zero
from commitlens.operators.ranking import group_quantiles
from commitlens.session import cut

SIZES = {"lines": "total_lines_added", "files": "total_files_count"}


def quantile_thresholds(
    commits: DataFrame,
    q_lines: float = fixed.OUTLIER_QUANTILE,
    q_files: float = fixed.OUTLIER_QUANTILE,
) -> DataFrame:
    """Per repository the sizes from which a commit counts as an outlier."""
    long = commits.select(
        "repository",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), to_number_or_zero(F.col(c)).alias("size"))
                    for m, c in SIZES.items()
                ]
            )
        ).alias("s"),
    ).select("repository", "s.metric", "s.size")
    wanted = {"lines": q_lines, "files": q_files}
    each = group_quantiles(long, ["repository", "metric"], "size", wanted)
    return each.groupBy("repository").agg(
        *[F.max(F.when(F.col("metric") == m, F.col(m))).alias(f"thr_{m}") for m in wanted]
    )


def flag_commits(commits: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Commits with their repository's thresholds and what they exceed."""
    return (
        commits.withColumns({c: to_number_or_zero(F.col(c)) for c in SIZES.values()})
        .join(thresholds, "repository")
        .withColumn("out_due_to_lines", F.col("total_lines_added") >= F.col("thr_lines"))
        .withColumn("out_due_to_files", F.col("total_files_count") >= F.col("thr_files"))
        .withColumn("is_outlier", F.col("out_due_to_lines") | F.col("out_due_to_files"))
    )


def outlier_commits(flagged: DataFrame) -> DataFrame:
    return flagged.where("is_outlier").select(
        "repository",
        "commit_hash",
        "total_lines_added",
        "total_files_count",
        "out_due_to_lines",
        "out_due_to_files",
        "thr_lines",
        "thr_files",
    )


def commits_with_pairs(commits: DataFrame, pairs: DataFrame) -> DataFrame:
    """Commits of repositories that have pairs; the others are not judged."""
    known = cut(pairs.select("repository").distinct(), "repositories")
    return commits.join(known, "repository", "left_semi")


def relabel_pairs(pairs: DataFrame, flagged: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Pairs of one outlier commit become SAME_COMMIT_OUTLIER.

    The flag stays null for other pairs and in repositories without
    thresholds, which are those without commits.
    """
    outliers = (
        flagged.where("is_outlier")
        .select("repository", F.col("commit_hash").alias("test_commit"))
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    judged = thresholds.select("repository", F.lit(True).alias("_judged"))
    same = F.col("classification") == "SAME_COMMIT"
    return (
        pairs.join(outliers, ["repository", "test_commit"], "left")
        .join(judged, "repository", "left")
        .select(
            *pairs.columns,
            F.when(same & F.col("_judged"), F.coalesce("_hit", F.lit(False))).alias(
                "same_commit_is_outlier"
            ),
            F.when(same & F.col("_hit"), "SAME_COMMIT_OUTLIER")
            .otherwise(F.col("classification"))
            .alias("classification_adj"),
        )
    )


def outlier_summary(
    flagged: DataFrame,
    adjusted: DataFrame,
    q_lines: float = fixed.OUTLIER_QUANTILE,
    q_files: float = fixed.OUTLIER_QUANTILE,
) -> DataFrame:
    """One audit row per repository with commits and pairs."""
    # Distinct hashes in two steps, so a repository is counted in parts.
    per_hash = flagged.groupBy("repository", "commit_hash").agg(
        F.count("*").alias("rows"),
        F.count_if("is_outlier").alias("outlier_rows"),
        F.max("thr_lines").alias("thr_lines"),
        F.max("thr_files").alias("thr_files"),
    )
    sizes = per_hash.groupBy("repository").agg(
        F.sum("rows").alias("commit_size_rows"),
        F.max("thr_lines").alias("thr_lines"),
        F.max("thr_files").alias("thr_files"),
        F.count_if(F.col("outlier_rows") > 0).alias("outlier_commits"),
        F.sum("outlier_rows").alias("_outlier_rows"),
    )
    counts = adjusted.groupBy("repository").agg(
        F.count("*").alias("pairs_rows"),
        F.count_if(F.col("classification") == "SAME_COMMIT").alias("same_commit_pairs"),
        F.count_if(F.col("classification_adj") == "SAME_COMMIT_OUTLIER").alias(
            "same_commit_pairs_relabeled"
        ),
    )
    return sizes.join(counts, "repository").select(
        "repository",
        "commit_size_rows",
        "pairs_rows",
        F.lit(q_lines).alias("q_lines"),
        F.lit(q_files).alias("q_files"),
        "thr_lines",
        "thr_files",
        "outlier_commits",
        (F.col("_outlier_rows") / F.col("commit_size_rows")).alias("outlier_commit_fraction"),
        "same_commit_pairs",
        "same_commit_pairs_relabeled",
        ratio(F.col("same_commit_pairs_relabeled"), F.col("same_commit_pairs")).alias(
            "same_commit_pairs_relabeled_fraction"
        ),
    )


def summary_adjusted(adjusted: DataFrame) -> DataFrame:
    """Per repository class counts and percentages, with and without outliers."""

    def count(label: str):
        return F.count_if(F.col("classification_adj") == label)

    counts = adjusted.groupBy("repository").agg(
        F.count("*").alias("matched_pairs"),
        count("TEST_FIRST").alias("test_first_count"),
        count("SAME_COMMIT").alias("same_commit_count"),
        count("SAME_COMMIT_OUTLIER").alias("same_commit_outlier_count"),
        count("PRODUCTION_FIRST").alias("prod_first_count"),
    )
    kinds = ("test_first", "same_commit", "same_commit_outlier", "prod_first")
    kept = F.col("matched_pairs") - F.col("same_commit_outlier_count")
    return counts.select(
        "*",
        *[
            percent(F.col(f"{k}_count"), F.col("matched_pairs")).alias(f"{k}_pct")
            for k in kinds
        ],
        *[
            percent(F.col(f"{k}_count"), kept).alias(f"{k}_adj_pct")
            for k in kinds
            if k != "same_commit_outlier"
        ],
    )
