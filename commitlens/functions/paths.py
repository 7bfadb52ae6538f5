"""Rules on file paths, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from commitlens.functions import fixed


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _any_of(patterns) -> str:
    return "^(?:" + "|".join(patterns) + ")"


def _contains_any(text: Column, pieces) -> Column:
    found = F.lit(False)
    for piece in pieces:
        found = found | text.contains(piece)
    return found


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    head = F.substr(path, F.lit(1), F.length(path) - F.length(basename(path)))
    bare = F.rtrim(head, F.lit("/"))
    return F.when(bare == "", head).otherwise(bare)


def is_java_file(path: Column) -> Column:
    return path.endswith(".java")


def is_excluded(path: Column, patterns=fixed.EXCLUDED_PATHS) -> Column:
    return path.rlike("(?i)" + _any_of(patterns))


def is_test_helper(path: Column, patterns=fixed.HELPER_NAMES) -> Column:
    return basename(path).rlike(_any_of(patterns))


def is_test_file(path: Column) -> Column:
    lowered = F.lower(path)
    return (
        F.when(_contains_any(lowered, fixed.NOT_UNIT_TEST_DIRS), False)
        .when(basename(path).rlike(_any_of(fixed.INTEGRATION_NAMES)), False)
        .when(basename(path).rlike(_any_of(fixed.UNIT_TEST_NAMES)), True)
        .otherwise(_contains_any(lowered, fixed.UNIT_TEST_DIRS))
    )


def class_name(path: Column) -> Column:
    return F.replace(basename(path), F.lit(".java"), F.lit(""))


def package_path(path: Column) -> Column:
    """Module and package of a file, test roots read as production roots."""

    def as_main(p: Column) -> Column:
        chain = F.when(F.lit(False), p)
        for test_root, main_root in fixed.TEST_TO_MAIN:
            chain = chain.when(
                p.contains(test_root), F.replace(p, F.lit(test_root), F.lit(main_root))
            )
        return chain.otherwise(p)

    def parts(p: Column) -> Column:
        """[module, package] at the first root the path holds."""
        chain = F.when(F.lit(False), F.array(p, p))
        for root in fixed.SOURCE_ROOTS:
            before = F.substring_index(p, root, 1)
            after = F.substr(p, F.length(before) + F.lit(len(root) + 1))
            chain = chain.when(
                p.contains(root), F.array(F.rtrim(before, F.lit("/")), dirname(after))
            )
        return chain.otherwise(F.array(F.lit(""), dirname(p)))

    return let(
        F.replace(path, F.lit("\\"), F.lit("/")),
        lambda p: let(
            as_main(p),
            lambda q: F.array_join(F.filter(parts(q), lambda part: part != ""), "/"),
        ),
    )


def similar_keys(package: Column) -> Column:
    """Keys two packages share exactly when they are similar.

    Similar means: not empty, and equal once test directories read as main,
    or equal in the last three segments.  Either is an equality, so a join
    on these keys needs no comparison of pairs.
    """
    as_main = F.replace(
        F.replace(package, F.lit("/test/"), F.lit("/main/")), F.lit("/tests/"), F.lit("/main/")
    )
    segments = F.filter(F.split(package, "/"), lambda s: s != "")
    tail = F.array_join(F.slice(segments, -fixed.SIMILAR_SEGMENTS, fixed.SIMILAR_SEGMENTS), "/")
    long_enough = F.size(segments) >= fixed.SIMILAR_SEGMENTS
    keys = F.array(
        F.when(package != "", F.concat(F.lit("main:"), as_main)),
        F.when((package != "") & long_enough, F.concat(F.lit("tail:"), tail)),
    )
    return F.array_compact(keys)


def packages_similar(left: Column, right: Column) -> Column:
    return F.arrays_overlap(similar_keys(left), similar_keys(right))


def tree_java_file(path: Column, kind: Column) -> Column:
    """A counted source file of a repository tree."""
    return (
        (kind == "blob")
        & is_java_file(path)
        & ~basename(path).isin(*fixed.TREE_METADATA_NAMES)
        & ~_contains_any(path, fixed.TREE_GENERATED)
    )


def tree_test_file(path: Column) -> Column:
    return basename(path).rlike(_any_of(fixed.TREE_TEST_NAMES))
