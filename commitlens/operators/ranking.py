"""Row numbers and exact quantiles for groups too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitlens.session import cut



def number_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    name: str = "n",
    slices: int | None = None,
    total: str | None = None,
) -> DataFrame:
    """Number the rows of each key 1, 2, ... in ``order`` (a total order).

    One window per key would sort a whole key in one task.  Here the rows are
    range-partitioned on key and order and sorted, which is the only shuffle
    of rows; the place of a row in its partition comes with it and is written
    down.  What a key has in earlier partitions is a prefix sum over a few
    figures, one for each key and partition, that are joined back.  ``total``
    names a column for the number of rows of the key.
    """
    spark = df.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order]
    # Partition and row of each row, taken after the sort.
    sliced = cut(
        df.repartitionByRange(slices, *by)
        .sortWithinPartitions(*by)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_id", 33)),
        "slices",
    )
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sliced.groupBy(*keys, "_slice").agg(F.min("_id").alias("_first"), F.count("*").alias("_size"))
    starts = sizes.select(
        *keys,
        "_slice",
        (F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_start"),
        *([F.sum("_size").over(whole).alias(total)] if total else []),
    )
    numbered = join_groups(sliced, starts, [*keys, "_slice"]).withColumn(name, F.col("_id") + F.col("_start"))
    return numbered.select(*df.columns, name, *([total] if total else []))


def packed_order(high: str, low: str) -> Column:
    """Two non-negative longs as one number of the same order.

    The extreme of a number is found by hash aggregation, which combines before
    the shuffle; that of a struct or a text would sort every row first.
    """
    return F.col(high).cast("decimal(19,0)") * F.lit("1" + "0" * 19).cast("decimal(20,0)") + F.col(low).cast("decimal(19,0)")


def first_per_key(
    df: DataFrame, keys: list[str], order: list[Column], n: int
) -> DataFrame:
    """The first ``n`` rows of each key; Spark prunes to n before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= n).drop("_n")


def join_groups(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join on ``keys``, where a null group is a group like any other."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(named, same).drop(*(f"_right_{k}" for k in keys))


def group_quantiles(
    df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """Exact quantiles per key with linear interpolation, one column each.

    Equal values are counted before the shuffle, in the only pass over the
    rows.  The counts are range-partitioned on key and value into even slices;
    a running count over slices finds the one that holds each wanted rank, and
    only the values of those are ordered, so neither a key nor a frequent value
    nor a narrow range of values is ever gathered in one task.  Nulls
    and NaN are left out; column ``n`` holds the number of values.
    """
    names = list(probabilities)
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = cut(
        df.select(*keys, F.col(value).cast("double").alias("_v"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*keys, "_v")
        .agg(F.count("*").alias("_c"))
        .repartitionByRange(slices, *keys, "_v")
        .withColumn("_class", F.spark_partition_id()),
        "counts",
    )
    so_far = (Window.unboundedPreceding, Window.currentRow)
    by_class = Window.partitionBy(*keys).orderBy("_class").rowsBetween(*so_far)
    classes = (
        counts.groupBy(*keys, "_class")
        .agg(F.sum("_c").alias("_c"))
        .withColumn("_before", F.sum("_c").over(by_class) - F.col("_c"))
        .withColumn("n", F.sum("_c").over(Window.partitionBy(*keys)))
    )
    # The two ranks each quantile lies between, counted from 0.
    ranks = F.array(
        *[
            F.struct(F.lit(i).alias("q"), F.lit(side).alias("side"), rank.alias("rank"))
            for i, name in enumerate(names)
            for side, rank in (
                (0, F.floor((F.col("n") - 1) * F.lit(probabilities[name]))),
                (1, F.ceil((F.col("n") - 1) * F.lit(probabilities[name]))),
            )
        ]
    )
    # A few rows per key, written down so that their size is known: while it
    # is small, the counts are filtered in place instead of being shuffled.
    wanted = cut(
        classes.withColumn(
            "_ranks",
            F.filter(
                ranks,
                lambda r: (r["rank"] >= F.col("_before"))
                & (r["rank"] < F.col("_before") + F.col("_c")),
            ),
        )
        .where(F.size("_ranks") > 0)
        .select(*keys, "_class", "_before", "n", "_ranks"),
        "ranks",
    )
    inside = Window.partitionBy(*keys, "_class").orderBy("_v").rowsBetween(*so_far)
    found = (
        join_groups(counts, wanted, [*keys, "_class"])
        .withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))
        .withColumn(
            "_rank",
            F.explode(
                F.filter(
                    "_ranks",
                    lambda r: (r["rank"] < F.col("_upto"))
                    & (r["rank"] >= F.col("_upto") - F.col("_c")),
                )
            ),
        )
    )

    def at(i: int, side: int) -> Column:
        hit = (F.col("_rank.q") == i) & (F.col("_rank.side") == side)
        return F.max(F.when(hit, F.col("_v")))

    aggregated = [F.max("n").alias("n")]
    for i, _ in enumerate(names):
        aggregated += [at(i, 0).alias(f"_lo{i}"), at(i, 1).alias(f"_hi{i}")]
    flat = found.groupBy(*keys).agg(*aggregated)

    def between(i: int, name: str) -> Column:
        position = (F.col("n") - 1) * F.lit(probabilities[name])
        share = position - F.floor(position)
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return (low + (high - low) * share).alias(name)

    return flat.select(*keys, "n", *[between(i, name) for i, name in enumerate(names)])
