"""Mixing sources to target weights by hash thresholds.

Each source has a budget of words.  A budget above the source's size takes the
whole source several times; what is left of it takes the documents whose hash
lies below a threshold, so a larger budget takes a superset.  Thresholds come
from histograms of words by source and hash bucket: running sums find the
bucket where the budget ends, and only this bucket is cut finer, again and again
until it is one hash value.  Nothing is sorted but the buckets of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitlens.llm.common import cut, fresh, prepared, words

#: A hash has 60 bits (15 hex digits); a level of the histograms looks at 12.
HASH_BITS, LEVEL_BITS = 60, 12


def hash_of(column: Column) -> Column:
    """60 bits of the MD5 of an id as text; a null id is the empty text."""
    digest = F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn and share all
    words.  A target stops at ``most`` times its source, the excess goes to the
    rest by weight: the level ``lam`` per weight is found over sources in the
    order of size per weight, where those that stop come first.  The windows run
    over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("place") % len(weights)).cast("int") + 1)
    ranked = sizes.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", weight.cast("long"))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranked = ranked.withColumns(
        {
            "left": F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "heavy": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    open_ = F.col("left") * F.col("weight") <= most * F.col("source_size") * F.col("heavy")
    level = F.when(open_, F.struct("place", (F.col("left") / F.col("heavy")).alias("lam")))
    # The first source in that order that does not stop sets the level.
    ranked = ranked.withColumn("turn", F.row_number().over(fill))
    lam = F.min(F.when(open_, F.struct("turn", level["lam"].alias("lam")))).over(everything)["lam"]
    target = F.least((most * F.col("source_size")).cast("double"), F.coalesce(lam, F.lit(0.0)) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def _level(rows: DataFrame, rest: DataFrame, shift: int) -> DataFrame:
    """One histogram: (source, bucket, rest) of the bucket in which each source's rest ends.

    ``rest`` becomes what is left for that bucket.  Sources without such a
    bucket (nothing left over) are missing.
    """
    hist = rows.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    run = hist.withColumn("upto", F.sum("words").over(w))
    run = run.join(rest.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    ends = run.filter("upto > rest").groupBy("source").agg(
        F.min(F.struct("bucket", (F.col("rest") - (F.col("upto") - F.col("words"))).alias("rest"), "words")).alias("e")
    )
    return ends.select("source", F.col("e.bucket").alias("bucket"), F.col("e.rest").alias("rest"), F.col("e.words").alias("words"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, passes, limit): documents with a hash below ``limit`` are taken once more than ``passes``.

    ``rows`` are (source, hash, size); ``goals`` (source, source_size, target).
    The group of equal hash where a budget ends is taken if that comes nearer.
    """
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = goals.select("source", passes.alias("passes"), (F.col("target") - passes * F.col("source_size")).alias("rest"))
    plan = cut(plan, "budgets")
    rest, found = plan.select("source", "rest"), None
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        found = cut(_level(rows, rest, shift), "ends")
        if not shift:
            break
        at = found.select(F.col("source").alias("s"), F.col("bucket").alias("b"))
        rows = rows.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", shift) == F.col("b")))
        rows = cut(rows.select("source", "hash", "size"), "boundary")
        rest = found.select("source", "rest")
    nearer = F.col("rest") * 2 >= F.col("words")
    ends = found.select(F.col("source").alias("s"), (F.col("bucket") + nearer.cast("long")).alias("limit"))
    joined = plan.join(ends, F.col("source").eqNullSafe(F.col("s")), "left")
    # Without an end nothing is left of the budget: no document has a hash below 0.
    return cut(joined.select("source", "passes", F.coalesce("limit", F.lit(0)).cast("long").alias("limit")), "limits")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    most: int = 3,
) -> DataFrame:
    """``docs`` with size, source_size, target and taken, appended last, without moving a text.

    A null or blank text has size 0; a null source is a source of its own, the
    last; rows of equal id in a source are taken together, as is every row
    without an id.  Reruns agree, as hashes depend on ids alone.  An empty table
    gives none; with no words at all targets are 0.  New columns whose names
    ``docs`` already has get an underscore.
    """
    prepared(docs.sparkSession)
    size, source_size, target, taken = fresh(docs, "size", "source_size", "target", "taken")
    sized = F.size(words(F.col(text_col))).cast("long")
    rows = cut(
        docs.select(F.col(source_col).alias("source"), hash_of(F.col(id_col)).alias("hash"), sized.alias("size")), "sizes"
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = cut(targets(sizes, weights, most), "targets")
    limits = thresholds(rows, goals)
    both = goals.join(limits.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    given = [f"_given_{i}" for i in range(len(docs.columns))]
    facts = cut(both.select(F.col("source").alias("_s"), "source_size", "target", "passes", "limit"), "facts")
    named = docs.toDF(*given).join(facts, F.col(given[docs.columns.index(source_col)]).eqNullSafe(F.col("_s")))
    own = F.size(words(F.col(given[docs.columns.index(text_col)]))).cast("long")
    extra = (hash_of(F.col(given[docs.columns.index(id_col)])) < F.col("limit")).cast("long")
    return named.select(
        *(F.col(g).alias(c) for g, c in zip(given, docs.columns, strict=True)),
        own.alias(size),
        F.col("source_size").alias(source_size),
        F.col("target").alias(target),
        (own * (F.col("passes") + extra)).alias(taken),
        (F.col("passes") + extra).alias(fresh(docs, "_copies")[0]),
    )


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: dropped, once or repeated."""
    found = mix(docs, **settings)
    copies = F.col(found.columns[-1])
    repeated = found.withColumn("_each", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))))
    return repeated.select(*docs.columns)
