"""Repository metadata, trees and commits to the shortlist to mine."""

from __future__ import annotations

from pyspark.sql import DataFrame

from commitlens.functions import fixed
from commitlens.operators import funnel


def candidates(stats: DataFrame, tree: DataFrame, language: str = "Java") -> DataFrame:
    """Mature repositories with their structure, in the written column order."""
    mature = funnel.filter_mature(stats, language)
    return funnel.reorder(funnel.with_structure(mature, tree))


def shortlist(found: DataFrame, min_java_files: int = fixed.MIN_JAVA_FILES) -> DataFrame:
    return funnel.reorder(funnel.sort_candidates(funnel.filter_final(found, min_java_files)))
