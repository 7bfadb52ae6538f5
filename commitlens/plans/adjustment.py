"""Commits and pairs to adjusted pairs and audit tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from commitlens.functions import fixed
from commitlens.operators import adjust
from commitlens.session import cut


@dataclass
class Adjustment:
    thresholds: DataFrame
    flagged: DataFrame
    outliers: DataFrame
    pairs: DataFrame
    audit: DataFrame
    summary: DataFrame


def adjust_pairs(
    commits: DataFrame,
    pairs: DataFrame,
    q_lines: float = fixed.OUTLIER_QUANTILE,
    q_files: float = fixed.OUTLIER_QUANTILE,
) -> Adjustment:
    """All tables of the adjustment from the written commits and pairs."""
    judged = adjust.commits_with_pairs(commits, pairs)
    # Written down, so the join with all commits knows how small they are.
    thresholds = cut(adjust.quantile_thresholds(judged, q_lines, q_files), "thresholds")
    # Both feed several outputs.
    flagged = cut(adjust.flag_commits(judged, thresholds), "flagged")
    adjusted = cut(adjust.relabel_pairs(pairs, flagged, thresholds), "adjusted")
    return Adjustment(
        thresholds,
        flagged,
        adjust.outlier_commits(flagged),
        adjusted,
        adjust.outlier_summary(flagged, adjusted, q_lines, q_files),
        adjust.summary_adjusted(adjusted),
    )
