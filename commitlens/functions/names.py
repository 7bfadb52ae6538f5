"""Production class names a test class may stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.functions import fixed
from commitlens.functions.paths import let


def fixed_terms() -> list[str]:
    """Names too general to match on, whatever the repositories under study."""
    return sorted(
        {
            *fixed.CLASS_PREFIXES,
            *fixed.TEST_WORDS,
            *fixed.UTILITY_WORDS,
            *fixed.COMMON_CLASSES,
            *fixed.COMMON_PROJECTS,
            *fixed.PROJECT_NAMES,
            *(name.capitalize() for name in fixed.PROJECT_NAMES),
        }
    )


def project_terms(repos: DataFrame, column: str = "repo") -> DataFrame:
    """Class-name spelling of project names as a table ``term``: ``commons-csv`` gives ``Commons``."""
    lead = F.regexp_extract(column, "^[^-_]+", 0)
    term = F.concat(F.upper(F.substring(lead, 1, 1)), F.substr(lead, F.lit(2)))
    return repos.where(lead != "").select(term.alias("term")).distinct()


def term_table(spark: SparkSession, terms: DataFrame | list[str] | tuple[str, ...] | None) -> DataFrame | None:
    """Terms besides the fixed ones as a table ``term``, of any size; None where there are none."""
    if isinstance(terms, DataFrame):
        return terms.select(F.col(terms.columns[0]).alias("term"))
    return spark.createDataFrame([(t,) for t in terms], "term string") if terms else None


def is_generic(names: DataFrame, column: str, terms: DataFrame | None = None) -> DataFrame:
    """``names`` with ``is_generic``: whether the column is a fixed term or one of the table."""
    known = F.coalesce(F.col(column).isin(*fixed_terms()), F.lit(False))
    if terms is None:
        return names.withColumn("is_generic", known)
    listed = terms.select(F.col("term").alias("_term")).distinct()
    return names.join(listed, F.col(column) == F.col("_term"), "left").select(
        *names.columns, (known | F.col("_term").isNotNull()).alias("is_generic")
    )


def _without_suffix(name: Column) -> Column:
    return F.regexp_replace(name, "(?:" + "|".join(fixed.TEST_SUFFIXES) + r")\z", "")


def _names_a_test_id(name: Column) -> Column:
    bare = F.replace(F.replace(name, F.lit("Test"), F.lit("")), F.lit("Case"), F.lit(""))
    return name.rlike("|".join(fixed.TEST_ID_NAMES)) | bare.rlike(fixed.NUMBERED_TAIL)


def _camel_prefixes(base: Column) -> Column:
    """Prefixes that end before an upper-case letter, longest first."""

    def prefixes(words: Column) -> Column:
        counts = F.reverse(F.sequence(F.lit(1), F.size(words) - 1))
        return F.filter(
            F.transform(counts, lambda n: F.array_join(F.slice(words, 1, n), "")),
            lambda prefix: F.length(prefix) >= fixed.SHORTEST_CANDIDATE,
        )

    return let(
        F.split(base, r"(?<=.)(?=\p{Lu})"),
        lambda words: F.when(F.size(words) > 1, prefixes(words)).otherwise(
            F.array().cast("array<string>")
        ),
    )


def candidate_offers(test_class: Column) -> Column:
    """Candidate production classes of a test class, most likely first.

    An offer (``name``, ``sure``) is no fixed term; one that is not ``sure``
    still has to be compared with the terms of a table.
    """
    none = F.array().cast("array<struct<name:string,sure:boolean>>")
    too_short = fixed.SHORTEST_CANDIDATE

    def offers(names: Column, sure: bool) -> Column:
        return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(sure).alias("sure")))

    def keep(names: Column) -> Column:
        return F.filter(
            F.array_distinct(names),
            lambda c: ~c.isin(*fixed_terms()) & ~c.rlike(fixed.NUMBERED_NAME),
        )

    def with_prefix(name: Column, base: Column) -> Column:
        after_prefix = F.when(
            name.rlike(r"^Test\p{Lu}"), _without_suffix(F.substr(name, F.lit(5)))
        )
        return let(
            F.when(
                F.length(after_prefix) >= too_short, F.array(after_prefix)
            ).otherwise(F.array().cast("array<string>")),
            lambda extra: F.when(base == "", offers(extra, True))
            .when(F.length(base) < fixed.SHORTEST_BASE, none)
            .when(F.length(base) < too_short, offers(F.array(base), True))
            .otherwise(offers(keep(F.concat(F.array(base), extra, _camel_prefixes(base))), False)),
        )

    return let(
        test_class,
        lambda name: F.when(_names_a_test_id(name), none).otherwise(
            let(_without_suffix(name), lambda base: with_prefix(name, base))
        ),
    )


def merged_offers(names: Column) -> Column:
    """Offers of several names of one file, in order."""
    return F.flatten(F.transform(names, candidate_offers))


def names_of(offers: Column) -> Column:
    """Names of offers in order, each once."""
    return F.array_distinct(F.transform(offers, lambda o: o["name"]))


def without_terms(df: DataFrame, keys: list[str], offers: str, terms: DataFrame | None) -> DataFrame:
    """``df`` with the array ``offers`` cut down to names that are no term of the table.

    ``keys`` are unique.  Offers are exploded with their place, joined against
    the terms and put together again in order, so terms may be as many as they
    like; rows without doubtful offers take no part in that.
    """
    if terms is None:
        return df.withColumn(offers, names_of(F.col(offers)))
    doubtful = F.exists(offers, lambda o: ~o["sure"])
    listed = terms.select(F.col("term").alias("_name")).distinct()
    kept = (
        df.where(doubtful)
        .select(*keys, F.posexplode(offers).alias("_place", "_offer"))
        .select(*keys, "_place", F.col("_offer.name").alias("_name"), F.col("_offer.sure").alias("_sure"))
    )
    kept = kept.join(listed.withColumn("_listed", F.lit(True)), "_name", "left").where("_sure or _listed is null")
    kept = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_place", "_name"))).alias("_kept"))
    left = F.array_distinct(F.transform("_kept", lambda k: k["_name"]))
    none = F.array().cast("array<string>")
    return (
        df.join(kept, keys, "left")
        .withColumn(offers, F.when(doubtful, F.coalesce(left, none)).otherwise(names_of(F.col(offers))))
        .drop("_kept")
    )
