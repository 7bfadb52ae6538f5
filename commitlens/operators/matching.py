"""Each test paired with its best production file.

A production file offers itself under (class name, key): its exact package,
the keys it shares with similar packages, and one key for any package.  Only
the best offer per class and key is kept, so a test meets one row per key and
pairs of a popular class name are never spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.functions import paths
from commitlens.functions.values import hours_between
from commitlens.operators.ranking import number_rows
from commitlens.session import cut

SAME, SIMILAR, DIFFERENT = 0, 1, 2
AGE_BITS = 42  # more files than that no table has
AGES = 1 << AGE_BITS
METHODS = (
    "exact_class_same_package",
    "exact_class_similar_package",
    "exact_class_different_package",
)


def _package_keys(packages: Column, any_package: Column) -> Column:
    """(method, key) under which a file with these packages can be met."""

    def entry(method: int, key: Column) -> Column:
        return F.struct(F.lit(method).alias("method"), key.alias("key"))

    same = F.transform(packages, lambda p: entry(SAME, p))
    similar = F.transform(
        F.array_distinct(F.flatten(F.transform(packages, paths.similar_keys))),
        lambda k: entry(SIMILAR, k),
    )
    anywhere = F.filter(
        F.array(entry(DIFFERENT, F.lit(""))), lambda _: any_package
    )
    return F.concat(same, similar, anywhere)


def by_age(files: DataFrame) -> DataFrame:
    """Production files with ``age``: their place by addition, then path.

    One number per file, so that the best offer of any group is the minimum of
    a number, which combines before the shuffle without a sort.
    """
    prods = files.where("not is_test").select("repo", "path", "commit_seq", "change_seq", "class_names", "packages")
    return number_rows(prods, [], ["commit_seq", "change_seq", "repo", "path"], "age")


def class_index(aged: DataFrame) -> DataFrame:
    """Best production file (its age) per repository, class name and package key.

    Best is the one added first; the path settles equal additions.
    """
    offers = aged.select(
        "repo", "age", "class_names", F.explode(_package_keys(F.col("packages"), F.lit(True))).alias("k")
    ).select("repo", "age", "k.method", "k.key", F.explode("class_names").alias("class_name"))
    return offers.groupBy("repo", "class_name", "method", "key").agg(F.min("age").alias("age"))


def _tests(files: DataFrame) -> DataFrame:
    return files.where("is_test and not is_helper")


def test_offers(files: DataFrame) -> DataFrame:
    """Candidates of each test, with the package keys to look them up by."""
    return (
        _tests(files)
        .select(
            "repo",
            F.col("path").alias("test_file"),
            "packages",
            F.posexplode("candidates").alias("candidate_rank", "class_name"),
        )
        .withColumn(
            "k",
            F.explode(_package_keys(F.col("packages"), F.col("candidate_rank") == 0)),
        )
        .select("repo", "test_file", "candidate_rank", "class_name", "k.method", "k.key")
    )


def _met(files: DataFrame, aged: DataFrame) -> DataFrame:
    return test_offers(files).join(class_index(aged), ["repo", "class_name", "method", "key"])


def _named(found: DataFrame, aged: DataFrame) -> DataFrame:
    """``found`` with the path of the production file of its ``age``."""
    return found.join(aged.select("age", F.col("path").alias("prod_file")), "age").drop("age")


def candidate_matches(files: DataFrame) -> DataFrame:
    """Best production file of each test, candidate and method."""
    aged = cut(by_age(files), "ages")
    best = (
        _met(files, aged)
        .groupBy("repo", "test_file", "candidate_rank", "class_name", "method")
        .agg(F.min("age").alias("age"))
    )
    return _named(best, aged)


def best_matches(files: DataFrame) -> DataFrame:
    """One production file per test: candidate order, then method, then age.

    The three are one number: the order of a candidate, two bits for the
    method and AGE_BITS for the age.  Nothing comes before the first candidate
    in a package of the test, so a test that meets it there is settled and
    offers no other keys.
    """
    aged = cut(by_age(files), "ages")
    first = cut(_first_in_package(files, aged), "settled")
    left = _tests(files).join(first.select("repo", F.col("test_file").alias("path")), ["repo", "path"], "left_anti")
    rank = (F.col("candidate_rank").cast("long") * 4 + F.col("method")) * AGES + F.col("age")
    others = _met(left, aged).groupBy("repo", "test_file").agg(F.min(rank).alias("best"))
    best = (
        first.unionByName(others)
        .select(
            "repo",
            "test_file",
            F.expr(f"cast(best div {4 * AGES} as int)").alias("candidate_rank"),
            F.expr(f"cast(best div {AGES} % 4 as int)").alias("method"),
            (F.col("best") % AGES).alias("age"),
        )
    )
    tried = files.where("is_test").select("repo", F.col("path").alias("test_file"), "candidates")
    method = F.element_at(F.array(*map(F.lit, METHODS)), F.col("method") + 1)
    return _named(best, aged).join(tried, ["repo", "test_file"]).select(
        "repo",
        "test_file",
        "prod_file",
        F.element_at("candidates", F.col("candidate_rank") + 1).alias("matched_class"),
        "candidate_rank",
        "method",
        method.alias("match_method"),
    )


def _first_in_package(files: DataFrame, aged: DataFrame) -> DataFrame:
    """(repo, test_file, best) of tests whose first candidate lies in a package of theirs; ``best`` is its age."""
    sought = _tests(files).select(
        "repo",
        F.col("path").alias("test_file"),
        F.get("candidates", F.lit(0)).alias("class_name"),
        F.explode("packages").alias("key"),
    )
    offered = (
        aged.select("repo", "age", "class_names", F.explode("packages").alias("key"))
        .select("repo", "age", "key", F.explode("class_names").alias("class_name"))
        .groupBy("repo", "class_name", "key")
        .agg(F.min("age").alias("age"))
    )
    return (
        sought.join(offered, ["repo", "class_name", "key"])
        .groupBy("repo", "test_file")
        .agg(F.min((F.lit(SAME).cast("long") * AGES) + F.col("age")).alias("best"))
    )


def _side(files: DataFrame, side: str) -> DataFrame:
    """Columns of one side of a pair, named after it."""
    names = {
        "class_name": "class",
        "commit_hash": "commit",
        "commit_date": "date",
        "author": "author",
        "file_lines": "file_lines",
        "commit_lines": "commit_total_lines",
        "commit_files": "commit_files",
        "commit_java_files": "commit_java_files",
        "original_path": "original_file",
        "is_deleted": "is_deleted",
        "deletion_date": "deletion_date",
        "deletion_commit": "deletion_commit",
    }
    return files.select(
        "repo",
        F.col("path").alias(f"{side}_file"),
        *[F.col(c).alias(f"{side}_{n}") for c, n in names.items()],
        F.col("original_path").isNotNull().alias(f"{side}_was_renamed"),
    )


def classify(test_commit, prod_commit, test_date, prod_date) -> Column:
    """Which side came first; equal dates of two commits count as production."""
    return (
        F.when(test_commit == prod_commit, "SAME_COMMIT")
        .when(test_date < prod_date, "TEST_FIRST")
        .otherwise("PRODUCTION_FIRST")
    )


def pair_status(test_deleted: Column, prod_deleted: Column) -> Column:
    return (
        F.when(test_deleted & prod_deleted, "BOTH_DELETED")
        .when(test_deleted, "TEST_DELETED")
        .when(prod_deleted, "PROD_DELETED")
        .otherwise("ACTIVE")
    )


def make_pairs(files: DataFrame, matches: DataFrame) -> DataFrame:
    tests = _side(files.where("is_test"), "test")
    prods = _side(files.where("not is_test"), "prod")
    same = F.col("test_commit") == F.col("prod_commit")
    return (
        matches.select("repo", "test_file", "prod_file", "match_method")
        .join(tests, ["repo", "test_file"])
        .join(prods, ["repo", "prod_file"])
        .withColumn(
            "classification",
            classify(
                F.col("test_commit"), F.col("prod_commit"), F.col("test_date"), F.col("prod_date")
            ),
        )
        .withColumn(
            "time_diff_hours",
            F.when(same, F.lit(0.0)).otherwise(
                F.abs(hours_between(F.col("test_date"), F.col("prod_date")))
            ),
        )
        .withColumn("pair_status", pair_status(F.col("test_is_deleted"), F.col("prod_is_deleted")))
    )


def unmatched_tests(files: DataFrame, matches: DataFrame) -> DataFrame:
    """Tests without a pair, in repositories that have production files."""
    with_prods = cut(files.where("not is_test").select("repo").distinct(), "repositories")
    none = F.size("candidates") == 0
    return (
        files.where("is_test and not is_helper")
        .join(with_prods, "repo", "left_semi")
        .join(
            matches.select("repo", F.col("test_file").alias("path")), ["repo", "path"], "left_anti"
        )
        .select(
            "repo",
            F.col("path").alias("test_file"),
            F.col("class_name").alias("test_class"),
            "class_names",
            F.col("candidates").alias("candidates_tried"),
            F.when(none, "No valid production class candidates (likely integration test)")
            .otherwise("No matching production file found")
            .alias("reason"),
            "original_path",
            "commit_hash",
            "commit_date",
            "author",
            "is_helper",
        )
    )


def inventory_counts(files: DataFrame) -> DataFrame:
    """Tests, helpers and production files per repository.

    Helpers and deleted files count once per starting path, tests and
    production files once per final path.
    """

    def starts(condition: str) -> Column:
        return F.coalesce(F.sum(F.expr(f"if({condition}, chains, 0)")), F.lit(0))

    return files.groupBy("repo").agg(
        F.count_if("is_test").alias("test_files"),
        starts("is_helper").alias("test_helpers"),
        F.count_if(~F.col("is_test")).alias("prod_files"),
        F.count_if(F.expr("is_test and not is_helper")).alias("real_tests"),
        starts("is_test and is_deleted").alias("deleted_tests"),
        starts("not is_test and is_deleted").alias("deleted_prods"),
    )


CLASSES = {
    "test_first_count": "TEST_FIRST",
    "same_commit_count": "SAME_COMMIT",
    "prod_first_count": "PRODUCTION_FIRST",
}
STATUSES = {
    "active_pairs": "ACTIVE",
    "test_deleted_pairs": "TEST_DELETED",
    "prod_deleted_pairs": "PROD_DELETED",
    "both_deleted_pairs": "BOTH_DELETED",
}


def pair_counters(pairs: DataFrame) -> DataFrame:
    """All counters of a repository's pairs in one pass.

    Counted per production file first, which tells the shared ones and
    leaves a large repository in many parts.
    """
    kinds = {
        **{n: F.col("classification") == v for n, v in CLASSES.items()},
        **{n: F.col("pair_status") == v for n, v in STATUSES.items()},
        "deleted_pairs": F.col("pair_status") != "ACTIVE",
    }
    per_prod = pairs.groupBy("repo", "prod_file").agg(
        F.count("*").alias("tests"), *[F.count_if(c).alias(n) for n, c in kinds.items()]
    )
    return per_prod.groupBy("repo").agg(
        F.sum("tests").alias("matched_pairs"),
        F.count("*").alias("matched_prods"),
        F.count_if(F.col("tests") > 1).alias("multi_test_prods"),
        *[F.sum(n).alias(n) for n in kinds],
    )


def match_counts(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """Inventory, pairs, unmatched and shared files per repository.

    Nothing counts as unmatched in a repository that lacks tests or
    production files, as nothing is matched there.
    """
    both = (F.col("test_files") > 0) & (F.col("prod_files") > 0)
    counted = inventory_counts(files).join(pair_counters(pairs), "repo", "left").na.fill(0)
    return counted.withColumns(
        {
            "unmatched_tests": F.when(
                both, F.col("real_tests") - F.col("matched_pairs")
            ).otherwise(0),
            "unmatched_prods": F.when(
                both, F.col("prod_files") - F.col("matched_prods")
            ).otherwise(0),
        }
    )


def classification_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("repo").agg(
        *[F.count_if(F.col("classification") == v).alias(n) for n, v in CLASSES.items()]
    )


def pair_status_counts(pairs: DataFrame) -> DataFrame:
    status = F.col("pair_status")
    return pairs.groupBy("repo").agg(
        *[F.count_if(status == v).alias(n) for n, v in STATUSES.items()],
        F.count_if(status != "ACTIVE").alias("deleted_pairs"),
    )
