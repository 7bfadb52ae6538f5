"""Distributions, size statistics and figure data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.functions.values import to_bool, to_number
from commitlens.operators.ranking import group_quantiles, join_groups, number_rows
from commitlens.session import cut

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
METRICS = {
    "commit_total_lines": ("test_commit_total_lines", "prod_commit_total_lines"),
    "commit_files": ("test_commit_files", "prod_commit_files"),
    "commit_java_files": ("test_commit_java_files", "prod_commit_java_files"),
}
PREFERRED = ("SAME_COMMIT", "PRODUCTION_FIRST", "TEST_FIRST")


def melt(df: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """One row per key, named column and number."""
    entries = F.array(
        *[F.struct(F.lit(n).alias("metric"), c.alias("value")) for n, c in columns.items()]
    )
    return df.select(*keys, F.explode(entries).alias("_e")).select(
        *keys, "_e.metric", "_e.value"
    )


def numbers(columns: list[str]) -> dict[str, Column]:
    return {c: to_number(F.col(c)) for c in columns}


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each value, null included."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    total = counts.select(F.sum("count").alias("total")).scalar()
    return counts.select("value", "count", (F.col("count") / total).alias("proportion"))


def numeric_stats(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, min and max, one row per column."""
    keys = keys or []

    def all_of(x: Column, name: str) -> Column:
        return F.struct(
            F.count(x).alias("count"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std_dev"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
        ).alias(name)

    # One pass over the rows; only its result is turned into rows per column.
    wide = df.groupBy(*keys).agg(*[all_of(x, c) for c, x in numbers(columns).items()])
    return melt(wide, keys, {c: F.col(c) for c in columns}).select(*keys, "metric", "value.*")


def describe_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles per column."""
    quartiles = group_quantiles(
        melt(df, [], numbers(columns)),
        ["metric"],
        "value",
        {"p25": 0.25, "p50": 0.5, "p75": 0.75},
    ).drop("n")
    return numeric_stats(df, columns).join(quartiles, "metric", "left")


def column_stats_transposed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Min, median, max, mean and deviation, one row per column."""
    return describe_table(df, columns).select(
        "metric", "min", F.col("p50").alias("median"), "max", "mean", F.col("std_dev").alias("std")
    )


def flag_adoption(df: DataFrame, flags: list[str]) -> DataFrame:
    """How many rows have each flag set, features as rows."""

    def count(flag: Column) -> Column:
        # A feature nobody has (or everybody) leaves that cell empty.
        return F.nullif(F.count_if(flag), F.lit(0))

    wide = df.agg(
        *[
            F.struct(
                count(~F.col(f).cast("boolean")).alias("no"),
                count(F.col(f).cast("boolean")).alias("yes"),
            ).alias(f)
            for f in flags
        ]
    )
    return melt(wide, [], {f: F.col(f) for f in flags}).select(
        F.col("metric").alias("feature"), "value.*"
    )


def group_value_counts(df: DataFrame, column: str) -> DataFrame:
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), column)
    )


def top_k_groups(df: DataFrame, column: str, k: int = 15) -> DataFrame:
    return group_value_counts(df, column).limit(k)


def top_group_rows(df: DataFrame, column: str, k: int = 15) -> DataFrame:
    """Rows whose group is among the k most frequent."""
    return df.join(top_k_groups(df, column, k).select(column), column, "left_semi")


def box_stats(
    df: DataFrame, keys: list[str], value: str, fences: tuple[float, float] | None = None
) -> DataFrame:
    """Box-plot data per key: quartiles, mean and whiskers.

    Whiskers end at the last value within 1.5 interquartile ranges of the
    box, or within the two ``fences`` quantiles where these are given.
    """
    wanted = dict(QUARTILES)
    if fences:
        wanted |= {"low_fence": fences[0], "high_fence": fences[1]}
    values = df.select(*keys, to_number(F.col(value)).alias("_x")).where(F.col("_x").isNotNull())
    # Written down, so the join with all values knows how small they are.
    boxes = cut(group_quantiles(values, keys, "_x", wanted), "boxes")
    if not fences:
        reach = (F.col("q3") - F.col("q1")) * 1.5
        boxes = boxes.withColumn("low_fence", F.col("q1") - reach).withColumn(
            "high_fence", F.col("q3") + reach
        )
    # The mean and whiskers need one look at the values against the fences.
    joined = join_groups(values, boxes, keys)
    inside = joined.groupBy(*keys).agg(
        F.avg("_x").alias("mean"),
        F.min(F.when(F.col("_x") >= F.col("low_fence"), F.col("_x"))).alias("_low"),
        F.max(F.when(F.col("_x") <= F.col("high_fence"), F.col("_x"))).alias("_high"),
    )
    return join_groups(boxes, inside, keys).select(
        *keys,
        "n",
        "mean",
        "median",
        "q1",
        "q3",
        F.least("_low", "q1").alias("whisker_low"),
        F.greatest("_high", "q3").alias("whisker_high"),
    )


def histogram(
    df: DataFrame, columns: list[str], low: float = 0.0, high: float = 100.0, bins: int = 25
) -> DataFrame:
    """Equal-width bins per column; the last bin takes its right edge too."""
    inside = F.col("value").between(low, high)
    number = F.width_bucket(F.col("value"), F.lit(low), F.lit(high), F.lit(bins))
    return (
        melt(df, [], numbers(columns))
        .where(inside)
        .groupBy("metric", F.least(number, F.lit(bins)).alias("bin"))
        .agg(F.count("*").alias("count"))
    )


def histogram_overlay(adjusted: DataFrame) -> DataFrame:
    """Raw and adjusted percentages of each class in 25 bins."""
    kinds = ("test_first", "prod_first", "same_commit")
    raw = histogram(adjusted, [f"{k}_pct" for k in kinds])
    adj = histogram(adjusted, [f"{k}_adj_pct" for k in kinds])
    return (
        raw.withColumn("metric", F.regexp_replace("metric", "_pct$", ""))
        .withColumnRenamed("count", "with_outliers")
        .join(
            adj.withColumn("metric", F.regexp_replace("metric", "_adj_pct$", ""))
            .withColumnRenamed("count", "without_outliers"),
            ["metric", "bin"],
            "full",
        )
        .na.fill(0, ["with_outliers", "without_outliers"])
    )


def drop_outliers(pairs: DataFrame, flag: str = "same_commit_is_outlier") -> DataFrame:
    return pairs.where(~to_bool(F.col(flag)))


def at_least(df: DataFrame, column: str, smallest: float = 1.0) -> DataFrame:
    """Rows whose number is finite and not below ``smallest``."""
    x = F.col(column)
    return df.where(
        x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (x >= smallest)
    )


def size_box_stats(
    pairs: DataFrame,
    group: str = "classification",
    smallest: float = 1.0,
    with_outliers: bool = False,
) -> DataFrame:
    """Combined commit size of test and production, per class.

    A pair lacking either size, or smaller than ``smallest``, is left out.
    """
    kept = pairs if with_outliers else drop_outliers(pairs)
    test, prod = METRICS["commit_total_lines"]
    sized = at_least(
        kept.select(group, (to_number(F.col(test)) + to_number(F.col(prod))).alias("size")),
        "size",
        smallest,
    )
    quantiles = {**QUARTILES, "p5": 0.05, "p95": 0.95}
    means = sized.groupBy(group).agg(F.avg("size").alias("mean"))
    return (
        group_quantiles(sized, [group], "size", quantiles)
        .join(means, group)
        .select(group, "n", "mean", *quantiles)
    )


def in_preferred_order(df: DataFrame, column: str, order: tuple[str, ...] = PREFERRED) -> DataFrame:
    """Named labels first, in the given order; the others after, by name."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return df.orderBy(F.when(place > 0, place).otherwise(len(order) + 1), column)


def size_metrics() -> dict[str, Column]:
    """The nine sizes; a sum reads a missing side as 0."""
    metrics = {}
    for name, (test, prod) in METRICS.items():
        t, p = to_number(F.col(test)), to_number(F.col(prod))
        metrics |= {
            test: t,
            prod: p,
            f"sum_{name}": F.coalesce(t, F.lit(0.0)) + F.coalesce(p, F.lit(0.0)),
        }
    return metrics


def size_mean_median(
    pairs: DataFrame, group: str = "classification", with_outliers: bool = True
) -> DataFrame:
    """Mean and median of nine commit sizes per class, and its row count."""
    kept = pairs if with_outliers else drop_outliers(pairs)
    metrics = size_metrics()
    medians = group_quantiles(
        melt(kept, [group], metrics), [group, "metric"], "value", {"median": 0.5}
    )
    wide = medians.groupBy(group).agg(
        *[
            F.max(F.when(F.col("metric") == m, F.col("median"))).alias(f"{m}__median")
            for m in metrics
        ]
    )
    means = (
        kept.where(F.col(group).isNotNull())
        .groupBy(group)
        .agg(
            *[F.avg(c).alias(f"{m}__mean") for m, c in metrics.items()],
            F.count("*").alias("n_rows"),
        )
    )
    return means.join(wide, group, "left").select(
        group,
        *[f"{m}__mean" for m in metrics],
        *[f"{m}__median" for m in metrics],
        "n_rows",
    )


def commit_index(commits: DataFrame) -> DataFrame:
    """Position of each commit of its repository by date and hash, from 0."""
    numbered = number_rows(commits, ["repository"], ["commit_date", "commit_hash"], "_n")
    return numbered.withColumn("commit_index", F.col("_n") - 1).drop("_n")


def scatter_data(commits: DataFrame, outliers: DataFrame, repository: str) -> DataFrame:
    """Commits of one repository in date order with their outlier flags."""
    flags = outliers.where(F.col("repository") == repository).select(
        "commit_hash", "out_due_to_lines", "out_due_to_files"
    )
    own = commits.where(F.col("repository") == repository)
    return commit_index(own.join(flags, "commit_hash", "left")).select(
        "repository",
        "commit_index",
        "commit_hash",
        "commit_date",
        "total_lines_added",
        "total_files_count",
        to_bool(F.col("out_due_to_lines")).alias("is_outlier_lines"),
        to_bool(F.col("out_due_to_files")).alias("is_outlier_files"),
    )
