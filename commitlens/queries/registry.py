"""Registered queries and the tables they share within a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.operators import history, matching
from commitlens.plans import adjustment, mining, shortlist
from commitlens.queries import derived
from commitlens.session import cut, scratch_path, shared_folder
from commitlens.sources import writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(body):
        QUERIES[name] = lambda spark, sf_dir: body(tables(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return body

    return register


class Tables:
    """Tables of one folder.  Costly ones are written down on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def given(self, name: str) -> DataFrame:
        return derived.table(self.spark, self.sf_dir, name)

    def scratch(self, label: str) -> str:
        return scratch_path(self.spark, label)

    @cached_property
    def changes(self) -> DataFrame:
        return derived.file_changes(self.spark, self.sf_dir)

    @cached_property
    def terms(self) -> DataFrame:
        return derived.terms(self.spark, self.sf_dir)

    @cached_property
    def commit_stats(self) -> DataFrame:
        return cut(history.commit_stats(self.changes), "commits")

    @cached_property
    def events(self) -> DataFrame:
        return cut(history.file_events(self.changes), "events")

    @cached_property
    def backward(self) -> DataFrame:
        return cut(history.rename_edges(self.events, "backward"), "backward")

    @cached_property
    def forward(self) -> DataFrame:
        return cut(history.rename_edges(self.events, "forward"), "forward")

    @cached_property
    def chains(self) -> DataFrame:
        return cut(history.rename_chains(self.events, self.backward, self.forward), "chains")

    @cached_property
    def files(self) -> DataFrame:
        found = history.files_from_chains(
            self.chains,
            history.effective_additions(self.events),
            history.deletions(self.events, self.forward),
            self.commit_stats,
            self.terms,
        )
        return cut(found, "files")

    @cached_property
    def analysis(self) -> mining.Analysis:
        matches = cut(matching.best_matches(self.files), "matches")
        failed = self.spark.createDataFrame([], "repo string, error string, rows bigint")
        return mining.Analysis(self.commit_stats, self.files, matches, failed)

    @cached_property
    def pairs(self) -> DataFrame:
        return self.analysis.pairs

    @cached_property
    def summary(self) -> DataFrame:
        return self.analysis.summary

    @cached_property
    def commits_table(self) -> DataFrame:
        return writers.commits_table(self.commit_stats)

    @cached_property
    def pairs_table(self) -> DataFrame:
        return writers.pairs_table(self.pairs)

    @cached_property
    def adjustment(self) -> adjustment.Adjustment:
        return adjustment.adjust_pairs(self.commits_table, self.pairs_table)

    @cached_property
    def repo_stats(self) -> DataFrame:
        return derived.repo_stats(self.spark, self.sf_dir)

    @cached_property
    def repo_tree(self) -> DataFrame:
        return cut(derived.repo_tree(self.spark, self.sf_dir), "tree")

    @cached_property
    def candidates(self) -> DataFrame:
        return shortlist.candidates(self.repo_stats, self.repo_tree)

    @cached_property
    def graph(self) -> DataFrame:
        return cut(derived.commit_graph(self.spark, self.sf_dir), "graph")

    @cached_property
    def branches(self) -> DataFrame:
        return derived.branches(self.graph)


_KEPT: dict[tuple[str, str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Tables of this folder in this session, so no step is derived twice."""
    key = (spark.sparkContext.applicationId, shared_folder(spark), sf_dir)
    if key not in _KEPT:
        _KEPT[key] = Tables(spark, sf_dir)
    return _KEPT[key]


def forget() -> None:
    """Drop what is shared: the next query derives everything again."""
    _KEPT.clear()


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six decimals for results that depend on the order of a float sum."""
    return df.withColumns({c: F.round(c, 6) for c in columns})
