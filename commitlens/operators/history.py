"""From file changes to one row per file identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commitlens.functions import names, paths
from commitlens.operators.ranking import first_per_key, packed_order
from commitlens.operators.walks import Walks
from commitlens.session import cut

ORDER = ("commit_seq", "change_seq")
ADDED = (*ORDER, "commit_hash", "commit_date", "author", "lines")


def _timed(events: DataFrame) -> DataFrame:
    """Events with their order as one number ``_at``."""
    return events.withColumn("_at", packed_order(*ORDER))


def select_changes(
    changes: DataFrame,
    repos: list[str] | DataFrame | None = None,
    since=None,
    to=None,
    max_commits: int | None = None,
) -> DataFrame:
    """Bounded scan: some repositories, a date window, the first N commits."""
    if isinstance(repos, DataFrame):
        changes = changes.join(repos.select("repo").distinct(), "repo", "left_semi")
    elif repos is not None:
        changes = changes.where(F.col("repo").isin(*repos))
    if since is not None:
        changes = changes.where(F.col("commit_date") >= F.lit(since))
    if to is not None:
        changes = changes.where(F.col("commit_date") <= F.lit(to))
    if max_commits is not None:
        changes = changes.join(
            first_n_commits(changes, max_commits), ["repo", "commit_hash"], "left_semi"
        )
    return changes


def first_n_commits(changes: DataFrame, n: int) -> DataFrame:
    commits = changes.groupBy("repo", "commit_hash").agg(F.min("commit_seq").alias("commit_seq"))
    return first_per_key(commits, ["repo"], [F.col("commit_seq")], n)


def commit_stats(changes: DataFrame) -> DataFrame:
    """Lines, files and Java files of each commit; all files count.

    A commit is its hash.  Date and author are those of its first change in
    order; figures come from a hash aggregation, and only the first changes
    are looked up for the two texts.
    """
    java = (
        paths.is_java_file(F.coalesce("new_path", F.lit("")))
        | paths.is_java_file(F.coalesce("old_path", F.lit("")))
    ) & F.col("change_type").isNotNull()
    author = F.coalesce("author", F.lit("Unknown")).alias("author")
    per_spelling = changes.groupBy("repo", "commit_hash", "commit_date", author).agg(
        F.sum(F.coalesce("added_lines", F.lit(0))).alias("total_lines"),
        F.count("*").alias("files_count"),
        F.count_if(java).alias("java_files_count"),
        F.min(packed_order(*ORDER)).alias("_at"),
    )
    # One row per spelling of date and author, in practice one per commit.
    first = Window.partitionBy("repo", "commit_hash").orderBy("_at")
    whole = Window.partitionBy("repo", "commit_hash")
    return (
        per_spelling.withColumn("_n", F.row_number().over(first))
        .withColumns({c: F.sum(c).over(whole) for c in ("total_lines", "files_count", "java_files_count")})
        .where("_n = 1")
        .drop("_n", "_at")
    )


def file_events(changes: DataFrame) -> DataFrame:
    """ADD, RENAME and DELETE of Java files; other changes carry no event."""
    kind, path = F.col("change_type"), F.col("path")
    renamed_or_not = (kind != "RENAME") | F.col("old_path").isNotNull()
    return (
        changes.where(kind.isin("ADD", "RENAME", "DELETE"))
        .withColumn("path", F.when(kind == "DELETE", F.col("old_path")).otherwise(F.col("new_path")))
        .where(paths.is_java_file(path) & renamed_or_not)
        .where((kind == "DELETE") | ~paths.is_excluded(path))
        .select(
            "repo",
            *ORDER,
            "commit_hash",
            "commit_date",
            F.coalesce("author", F.lit("Unknown")).alias("author"),
            kind.alias("type"),
            "path",
            F.when(kind == "RENAME", F.col("old_path")).alias("old_path"),
            F.when(kind == "ADD", F.coalesce("added_lines", F.lit(0))).alias("lines"),
        )
    )


def file_timeline(events: DataFrame) -> DataFrame:
    """Additions and deletions of each path, in the order of ORDER."""
    return events.where(F.col("type").isin("ADD", "DELETE")).select(
        "repo", "path", *ORDER, "type", "commit_hash", "commit_date", "author", "lines"
    )


def effective_additions(events: DataFrame) -> DataFrame:
    """Per path the first ADD after the last DELETE, else the first ADD.

    Hash aggregations over one number find the order of the chosen addition,
    and its columns are looked up by that; no path is ever sorted.
    """
    timed = _timed(events)
    last_delete = (
        timed.where(F.col("type") == "DELETE").groupBy("repo", "path").agg(F.max("_at").alias("_gone"))
    )
    after = F.col("_gone").isNull() | (F.col("_at") > F.col("_gone"))
    chosen = (
        timed.where(F.col("type") == "ADD")
        .select("repo", "path", "_at")
        .join(last_delete, ["repo", "path"], "left")
        .groupBy("repo", "path")
        .agg(F.min(F.when(after, F.col("_at"))).alias("_after"), F.min("_at").alias("_first"))
        .select("repo", "path", F.coalesce("_after", "_first").alias("_chosen"))
    )
    added = events.where(F.col("type") == "ADD").select("repo", "path", *ADDED)
    return _met_at(added.join(chosen, ["repo", "path"]), "_chosen").select("repo", "path", *ADDED)


def _met_at(events: DataFrame, at: str) -> DataFrame:
    """Rows whose order is ``at``.

    Two comparisons and no equality, which would become a key of the join below
    and shuffle what is partitioned by path already.
    """
    own = packed_order(*ORDER)
    return events.where((own >= F.col(at)) & (own <= F.col(at)))


def deletions(events: DataFrame, forward: DataFrame) -> DataFrame:
    """Paths whose last event is a DELETE and that were not renamed away."""
    last = (
        _timed(events).where(F.col("type") != "RENAME").groupBy("repo", "path").agg(F.max("_at").alias("_last"))
    )
    renamed_away = forward.select("repo", F.col("src").alias("path"))
    deleted = events.where(F.col("type") == "DELETE").select("repo", "path", *ORDER, "commit_date", "commit_hash")
    return (
        _met_at(deleted.join(last, ["repo", "path"]), "_last")
        .join(renamed_away, ["repo", "path"], "left_anti")
        .select(
            "repo",
            "path",
            F.col("commit_date").alias("deletion_date"),
            F.col("commit_hash").alias("deletion_commit"),
        )
    )


def rename_edges(events: DataFrame, direction: str) -> DataFrame:
    """One edge per path: its last rename forward, or backward."""
    src, dst = ("old_path", "path") if direction == "forward" else ("path", "old_path")
    renames = events.where(F.col("type") == "RENAME").select(
        "repo", F.col(src).alias("src"), F.col(dst).alias("dst"), *ORDER
    )
    last = _timed(renames).groupBy("repo", "src").agg(F.max("_at").alias("_last"))
    return _met_at(renames.join(last, ["repo", "src"]), "_last").select("repo", "src", "dst")


def follow(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """Walk from each ``path`` along the edges to the end.

    ``last`` is where the walk ends: a path without an edge or, on a cycle,
    the first path seen twice.  ``trail`` lists the paths seen, in order.
    """
    return Walks(edges).trails(starts)


def _added_paths(events: DataFrame) -> DataFrame:
    return events.where(F.col("type") == "ADD").select("repo", "path").distinct()


def rename_origins(events: DataFrame, backward: DataFrame) -> DataFrame:
    """Original path of every added path."""
    return Walks(backward).lasts(_added_paths(events)).withColumnRenamed("last", "original")


def rename_chains(events: DataFrame, backward: DataFrame, forward: DataFrame) -> DataFrame:
    """Per starting path its final path and every path it ever had.

    Paths come in walk order from the original on.  On a backward cycle the
    rest of the cycle follows, as it belongs to the file as well.
    """
    back = Walks(backward)
    starting = cut(
        back.lasts(_added_paths(events)).select("repo", F.col("last").alias("path")).distinct(), "starting"
    )
    chains = Walks(forward).trails(starting)
    if back.looped:
        earlier = back.trails(starting).select("repo", "path", F.col("trail").alias("earlier"))
        chains = chains.join(earlier, ["repo", "path"]).withColumn("trail", F.array_union("trail", "earlier"))
    return chains.select(
        "repo", F.col("path").alias("original"), F.col("last").alias("final"), F.col("trail").alias("all_paths")
    )


def build_files(changes: DataFrame, commits: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """One row per file identity, keyed by its final path.

    ``commits`` are the commit_stats of the same changes, ``terms`` names too
    general to match on besides the fixed ones.
    """
    events = cut(file_events(changes), "events")
    backward = cut(rename_edges(events, "backward"), "backward")
    forward = cut(rename_edges(events, "forward"), "forward")
    chains = cut(rename_chains(events, backward, forward), "chains")
    return files_from_chains(
        chains,
        effective_additions(events),
        deletions(events, forward),
        commits,
        terms,
    )


def files_from_chains(
    chains: DataFrame,
    additions: DataFrame,
    deleted: DataFrame,
    commits: DataFrame,
    terms: DataFrame | None = None,
) -> DataFrame:
    # Where a chain begins and ends is mostly the path itself, which is shuffled once.
    steps = chains.select("repo", "original", "final", F.posexplode("all_paths").alias("step", "path")).select(
        "repo", "path", "step", *[F.when(F.col(c) != F.col("path"), F.col(c)).alias(c) for c in ("original", "final")]
    )
    final = F.coalesce("final", "path")
    found = steps.join(additions, ["repo", "path"]).select(
        "repo",
        final.alias("path"),
        F.when(F.coalesce("original", "path") != final, F.coalesce("original", "path")).alias("original_path"),
        "step",
        *ADDED,
    )
    # Chains that end at one path meet in one shuffle: of each the original's addition, or that of its first path with one.
    original = F.coalesce("original_path", "path")
    in_chain = Window.partitionBy("repo", "path", "original_path").orderBy("step")
    at_path = Window.partitionBy("repo", "path")
    # They are one file: the latest addition stands, of equal ones the last original.
    latest = at_path.orderBy(packed_order(*ORDER).desc(), original.desc())
    files = (
        found.repartition("repo", "path")
        .withColumn("_n", F.rank().over(in_chain))
        .where("_n = 1")
        .withColumn("chains", F.count("*").over(at_path))
        .withColumn("_n", F.row_number().over(latest))
        .where("_n = 1")
    )
    described = describe_files(_with_trails(files, chains).join(deleted, ["repo", "path"], "left").select(
        "repo",
        "path",
        "chains",
        "original_path",
        "commit_hash",
        "commit_date",
        "author",
        F.col("lines").alias("file_lines"),
        "commit_seq",
        "change_seq",
        F.col("deletion_commit").isNotNull().alias("is_deleted"),
        "deletion_date",
        "deletion_commit",
        "all_paths",
    ))
    # Candidates and totals are joined by a number, so that whole rows are shuffled once more only, without what repeats
    # the names of the last path.
    alone = {"class_names": F.array("class_name"), "packages": F.array("package_path")}
    short = {c: F.when(F.col(c) != own, F.col(c)) for c, own in alone.items()}
    described = cut(described.withColumns(short | {"_file": F.monotonically_increasing_id()}), "offers")
    sums = ("total_lines", "files_count", "java_files_count")
    totals = (
        described.select("_file", "repo", "commit_hash")
        .join(commits.select("repo", "commit_hash", *sums), ["repo", "commit_hash"])
        .select("_file", *sums)
    )
    settled = names.without_terms(described, ["_file"], "candidates", terms)
    alone["candidates"] = F.when(~F.col("is_test"), F.array("class_name"))
    settled = settled.withColumns({c: F.coalesce(c, own) for c, own in alone.items()})
    return settled.join(totals, "_file", "left").select(
        *[c for c in described.columns if c != "_file"],
        F.when(F.size("candidates") > 0, F.get("candidates", F.lit(0))).otherwise(F.col("class_name")).alias("base_class"),
        F.coalesce("total_lines", F.lit(0)).alias("commit_lines"),
        F.coalesce("files_count", F.lit(0)).alias("commit_files"),
        F.coalesce("java_files_count", F.lit(0)).alias("commit_java_files"),
    )


def _with_trails(files: DataFrame, chains: DataFrame) -> DataFrame:
    """``files`` with all paths of their chain; only chains of several paths are looked up, by the path they end at."""
    each = Window.partitionBy("repo", "path", "_original").orderBy("_original")
    trails = (
        chains.where(F.size("all_paths") > 1)
        .select("repo", F.col("final").alias("path"), F.col("original").alias("_original"), "all_paths")
        .repartition("repo", "path")
        .withColumn("_n", F.row_number().over(each))
        .where("_n = 1")
        .drop("_n")
    )
    files = files.drop("_n")
    original = F.coalesce("original_path", files["path"])
    same = (files["repo"] == trails["repo"]) & (files["path"] == trails["path"])
    # Not an equality either: files lie by path already.
    same &= (original >= F.col("_original")) & (original <= F.col("_original"))
    return files.join(trails, same, "left").select(
        *[files[c] for c in files.columns], F.coalesce("all_paths", F.array(files["path"])).alias("all_paths")
    )


def describe_files(files: DataFrame) -> DataFrame:
    """Test flags, class and package names of each file, and as ``candidates`` the offers of a test (null for other files)."""
    is_test = paths.is_test_file(F.col("path"))
    every_class = F.array_distinct(F.transform("all_paths", paths.class_name))
    every_package = F.array_distinct(F.transform("all_paths", paths.package_path))
    named = files.select(
        *[c for c in files.columns if c != "all_paths"],
        paths.class_name(F.col("path")).alias("class_name"),
        paths.package_path(F.col("path")).alias("package_path"),
        is_test.alias("is_test"),
        (is_test & paths.is_test_helper(F.col("path"))).alias("is_helper"),
        every_class.alias("class_names"),
        every_package.alias("packages"),
    )
    offers = names.merged_offers(F.array_union(F.array("class_name"), "class_names"))
    return named.withColumn("candidates", F.when(F.col("is_test"), offers))
