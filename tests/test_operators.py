"""Quantiles, numbering, graph, statistics and files against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from commitlens import schemas
from commitlens.operators import adjust, funnel, graph, ranking, stats
from commitlens.plans.adjustment import adjust_pairs
from commitlens.sources import readers, writers


def test_number_rows_is_row_number(spark):
    df = spark.range(5000).select(
        (F.col("id") % 3 == 0).cast("int").alias("k"), F.xxhash64("id").alias("v")
    )
    got = ranking.number_rows(df, ["k"], ["v"], "n", slices=7).toPandas()
    want = got.groupby("k")["v"].rank().astype(int)
    assert (got["n"] == want).all() and len(got) == 5000


@pytest.mark.parametrize("kind", ["ints", "floats", "negative", "constant", "tiny"])
def test_group_quantiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(5)
    values = {
        "ints": rng.integers(0, 100000, 3000).astype(float),
        "floats": rng.lognormal(3, 4, 3000),
        "negative": rng.normal(0, 50, 3000),
        "constant": np.full(3000, 7.0),
        "tiny": np.array([1.0, 2.0, 3.0, 10.0]),
    }[kind]
    pdf = pd.DataFrame({"g": np.where(np.arange(len(values)) % 4 == 0, "a", "hot"), "x": values})
    probs = {"q0": 0.0, "q1": 0.05, "q2": 0.5, "q3": 0.99, "q4": 1.0}
    got = ranking.group_quantiles(spark.createDataFrame(pdf), ["g"], "x", probs).toPandas()
    for row in got.itertuples():
        own = pdf.loc[pdf.g == row.g, "x"]
        assert row.n == len(own)
        np.testing.assert_allclose(
            [row.q0, row.q1, row.q2, row.q3, row.q4],
            own.quantile(list(probs.values())), rtol=1e-12, atol=1e-12,
        )


def test_quantile_of_the_documented_case(spark):
    df = spark.createDataFrame([("r", x) for x in (1, 2, 3, 10, None)], "g string, x int")
    assert ranking.group_quantiles(df, ["g"], "x", {"q": 0.99}).first().q == pytest.approx(9.79)


def commits_and_pairs(spark):
    commits = [("r", f"h{i}", i, 1) for i in range(100)] + [("one", "z", 5, 5), ("idle", "y", 1, 1)]
    pairs = [("r", "SAME_COMMIT", "h99"), ("r", "SAME_COMMIT", "h5"), ("r", "TEST_FIRST", "h99"),
             ("one", "SAME_COMMIT", "z"), ("bare", "SAME_COMMIT", "q")]
    return (
        spark.createDataFrame(
            commits,
            "repository string, commit_hash string, total_lines_added bigint, total_files_count bigint",
        ),
        spark.createDataFrame(pairs, "repository string, classification string, test_commit string"),
    )


def test_adjustment(spark):
    commits, pairs = commits_and_pairs(spark)
    # All files counts are 1 in r, so by >= every commit of r is an outlier.
    result = adjust_pairs(commits, pairs)
    got = {(p.repository, p.classification, p.test_commit):
           (p.same_commit_is_outlier, p.classification_adj) for p in result.pairs.collect()}
    assert got == {
        ("r", "SAME_COMMIT", "h99"): (True, "SAME_COMMIT_OUTLIER"),
        ("r", "SAME_COMMIT", "h5"): (True, "SAME_COMMIT_OUTLIER"),
        ("r", "TEST_FIRST", "h99"): (None, "TEST_FIRST"),
        ("one", "SAME_COMMIT", "z"): (True, "SAME_COMMIT_OUTLIER"),
        ("bare", "SAME_COMMIT", "q"): (None, "SAME_COMMIT"),
    }
    audit = {a.repository: a for a in result.audit.collect()}
    assert set(audit) == {"r", "one"}
    assert audit["r"].outlier_commits == 100 and audit["r"].outlier_commit_fraction == 1.0
    totals = {s.repository: s for s in result.summary.collect()}
    assert totals["one"].same_commit_adj_pct == 0.0 and totals["one"].same_commit_outlier_pct == 100
    for s in totals.values():
        parts = s.test_first_adj_pct + s.same_commit_adj_pct + s.prod_first_adj_pct
        assert parts == pytest.approx(100) or parts == 0
    assert result.pairs.count() == pairs.count()


def test_outliers_by_lines(spark):
    commits, pairs = commits_and_pairs(spark)
    commits = commits.withColumn("total_files_count", F.col("total_lines_added"))
    flagged = adjust_pairs(commits, pairs).flagged.where("repository = 'r' and is_outlier")
    assert [r.commit_hash for r in flagged.collect()] == ["h99"]
    doubled = commits.unionByName(commits)
    assert adjust_pairs(doubled, pairs).pairs.count() == pairs.count()


def test_commits_that_share_a_short_hash_are_apart(spark):
    hashes = ["deadbeef" + "0" * 32, "deadbeef" + "1" * 32]
    rows = [("r", hashes[0], "d", "a", 5, 1, 1), ("r", hashes[1], "d", "a", 500, 9, 1)]
    commits = writers.commits_table(spark.createDataFrame(
        rows, "repo string, commit_hash string, commit_date string, author string, "
        "total_lines bigint, files_count bigint, java_files_count bigint"))
    pairs = spark.createDataFrame(
        [("r", "SAME_COMMIT", h) for h in hashes],
        "repository string, classification string, test_commit string",
    )
    result = adjust_pairs(commits, pairs)
    got = {p.test_commit: p.classification_adj for p in result.pairs.collect()}
    assert got == {hashes[0]: "SAME_COMMIT", hashes[1]: "SAME_COMMIT_OUTLIER"}
    assert result.audit.first().outlier_commits == 1
    written = writers.short_hashes(result.pairs).select("test_commit").collect()
    assert {r.test_commit for r in written} == {"deadbeef"}


def test_short_hash_collision_counts_hashes_once(spark):
    commits, pairs = commits_and_pairs(spark)
    twice = commits.unionByName(commits.where("commit_hash = 'h99'"))
    audit = adjust_pairs(twice, pairs).audit.where("repository = 'r'").first()
    assert (audit.commit_size_rows, audit.outlier_commits) == (101, 100)


def random_graph(seed, size=60):
    rng = random.Random(seed)
    rows = []
    for n in range(size):
        parents = sorted({rng.randint(max(0, n - 6), n - 1) for _ in range(rng.randint(1, 2))}) if n else []
        rng.shuffle(parents)
        rows.append(("r", f"{n:03d}", [f"{p:03d}" for p in parents]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_reachability_equals_depth_first_search(spark, seed):
    rows = random_graph(seed)
    rows += [("line", f"{n:03d}", [f"{n - 1:03d}"] if n else []) for n in range(200)]
    commits = spark.createDataFrame(rows, "repo string, oid string, parents array<string>")
    heads = [("r", "main", "050"), ("r", "old", "020"), ("r", "new", "059"), ("r", "lost", "zzz"),
             ("line", "master", "150"), ("line", "a", "151")]
    branches = spark.createDataFrame(heads, "repo string, branch string, head string")
    got = {(b.repo, b.branch): b.reachable
           for b in graph.branch_reachability(commits, branches).collect()}
    parents = {(r, o): p for r, o, p in rows}

    def closure(repo, head):
        seen, todo = set(), [head]
        while todo:
            cur = todo.pop()
            if cur not in seen:
                seen.add(cur)
                todo += parents[repo, cur]
        return seen

    main = {"r": closure("r", "050"), "line": closure("line", "150")}
    assert got == {(r, b): h in main[r] for r, b, h in heads}
    reached = graph.reachable(commits, branches.where("branch in ('main', 'master')"))
    assert {(x.repo, x.oid) for x in reached.collect()} == {(r, o) for r in main for o in main[r]}


def test_reachability_with_cut_off_history(spark):
    commits = spark.createDataFrame(
        [("r", "b", ["a"]), ("r", "c", ["b"])], "repo string, oid string, parents array<string>"
    )
    heads = spark.createDataFrame([("r", "c")], "repo string, head string")
    assert {x.oid for x in graph.reachable(commits, heads).collect()} == {"b", "c"}


def test_main_branch(spark):
    branches = spark.createDataFrame(
        [("a", "x", "1"), ("a", "master", "2"), ("b", "z", "3"), ("b", "y", "4"), ("c", "main", "5"),
         ("c", "master", "6")], "repo string, branch string, head string",
    )
    got = {b.repo: b.branch for b in graph.main_branch(branches).collect()}
    assert got == {"a": "master", "b": "y", "c": "main"}


def test_squash_candidates(spark):
    commits = spark.createDataFrame(
        [("r", "a", ["x"], 20, 0), ("r", "b", ["x"], 0, 500), ("r", "c", ["x"], 19, 499),
         ("r", "d", ["x", "y"], 99, 999), ("r", "e", [], 99, 999)],
        "repo string, oid string, parents array<string>, files_changed bigint, lines_changed bigint",
    )
    assert {c.oid for c in graph.squash_candidates(commits).collect()} == {"a", "b"}


def test_chunks_are_ceil_sized(spark):
    parts = funnel.chunks(spark.range(391).withColumnRenamed("id", "repo"), ["repo"])
    sizes = [r["count"] for r in parts.groupBy("part").count().orderBy("part").collect()]
    assert sizes == [79, 79, 79, 79, 75]


def test_filters(spark):
    meta = spark.createDataFrame(
        [("a", "Java", False, False, 5, ("Apache-2.0",)), ("b", "Java", False, False, None, None),
         ("c", "Go", True, False, 9, ("Apache-2.0",))],
        "name string, language string, fork boolean, archived boolean, size bigint,"
        "license struct<spdx_id string>",
    )

    def names(**kw):
        return {r.name for r in funnel.filter_repo_meta(meta, **kw).collect()}

    assert names() == {"a"}
    assert names(require_apache_license=False) == {"a", "b"}
    assert names(exclude_forks=False, min_size=9) == {"c"}
    assert names(require_apache_license=False, max_size=0) == {"b"}


def test_tree(spark):
    tree = spark.createDataFrame(
        [("r", "pom.xml", "blob"), ("r", "a/FooTest.java", "blob"), ("r", "a/Foo.java", "blob"),
         ("r", "a/package-info.java", "blob"), ("r", "target/generated-sources/X.java", "blob"),
         ("r", "a/Tested.java", "dir"), ("r", "a/b/c/tests", "dir"), ("s", "x/.github", "dir"),
         ("s", "a/My-Tests", "dir")], schemas.REPO_TREE,
    )
    counts = {c.repo: tuple(c)[1:] for c in funnel.tree_counts(tree).collect()}
    assert counts == {"r": (2, 1, 0.5), "s": (0, 0, 0.0)}
    flags = {f.repo: tuple(f)[1:] for f in funnel.root_flags(tree).collect()}
    assert flags == {"r": (True, False), "s": (False, False)}
    near = {h.repo: h.has_test_dir for h in funnel.has_test_dir(tree, max_depth=1).collect()}
    assert near == {"r": True, "s": True}


def test_empty_and_failed_repositories(spark):
    meta = spark.createDataFrame(
        [("a", "Java", 1, 1), ("b", "Java", 1, 1), ("c", "Java", 1, 1)],
        "name string, language string, stargazers_count bigint, forks_count bigint",
    )
    spans = spark.sql(
        """select 'a' repo, 4L num_commits, timestamp '2020-01-01' first_commit_date,
        timestamp '2020-01-03' last_commit_date"""
    )
    failed = spark.createDataFrame([("c",)], "repo string")
    got = {s.repo: (s.num_commits, s.project_life_days)
           for s in funnel.repo_stats(meta, spans, failed).collect()}
    assert got == {"a": (4.0, 2.0), "b": (0.0, None), "c": (None, None)}


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (3.999,), (4.0,), (100.0,), (96.0,), (101.0,)], "x double")
    got = {r.bin: r["count"] for r in stats.histogram(df, ["x"]).collect()}
    assert got == {1: 2, 2: 1, 25: 2}


def test_box_whiskers(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 50.0]
    df = spark.createDataFrame([("g", x) for x in values], "g string, x double")
    box = stats.box_stats(df, ["g"], "x").first()
    assert (box.whisker_low, box.whisker_high, box.median) == (1.0, 5.0, 3.5)
    fenced = stats.box_stats(df, ["g"], "x", fences=(0.05, 0.95)).first()
    assert (fenced.whisker_low, fenced.whisker_high) == (2.0, 5.0)


def test_size_stats_and_missing_sides(spark):
    columns = [c for pair in stats.METRICS.values() for c in pair]
    rows = [("A", "false", 1, None, 1, 1, 1, 1), ("A", None, 3, 4, 1, 1, 1, 1),
            ("A", "True", 100, 100, 9, 9, 9, 9), ("B", None, 0, 0, 0, 0, 0, 0)]
    pairs = spark.createDataFrame(
        rows, "classification string, same_commit_is_outlier string, "
        + ", ".join(f"{c} int" for c in columns),
    )
    means = {r.classification: r for r in
             stats.size_mean_median(pairs, with_outliers=False).collect()}
    assert means["A"].sum_commit_total_lines__mean == 4.0 and means["A"].n_rows == 2
    assert means["A"].prod_commit_total_lines__median == 4.0
    boxes = {r.classification: r for r in stats.size_box_stats(pairs).collect()}
    assert set(boxes) == {"A"} and (boxes["A"].n, boxes["A"].median) == (1, 7.0)


def test_distribution_keeps_null(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "x string")
    got = {r.value: (r["count"], r.proportion) for r in stats.value_distribution(df, "x").collect()}
    assert got == {"a": (2, 0.5), None: (1, 0.25), "b": (1, 0.25)}


def test_preferred_order(spark):
    df = spark.createDataFrame([("Z",), ("TEST_FIRST",), ("A",), ("SAME_COMMIT",)], "c string")
    got = [r.c for r in stats.in_preferred_order(df, "c").collect()]
    assert got == ["SAME_COMMIT", "TEST_FIRST", "A", "Z"]


def test_combined_parts_and_text_hashes(spark, tmp_path):
    a = spark.createDataFrame([("r1", "00123456", 1)], "repo string, hash string, n bigint")
    b = spark.createDataFrame([(2, "r2")], "n bigint, repo string")
    writers.write_csv(a, f"{tmp_path}/a")
    writers.write_csv(b, f"{tmp_path}/b")
    back = readers.scan_csv_by_name(
        spark, [f"{tmp_path}/a", f"{tmp_path}/b"], "repo string, hash string, n bigint"
    )
    assert {tuple(r) for r in back.collect()} == {("r1", "00123456", 1), ("r2", None, 2)}


def test_text_with_breaks_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([('a "b"\nc, d',), ("",)], "x string")
    writers.write_csv(df, f"{tmp_path}/t")
    back = readers.scan_csv(spark, f"{tmp_path}/t", "x string", multi_line=True)
    assert 'a "b"\nc, d' in {r.x for r in back.collect()}


def test_cached_json_is_written_once(spark, tmp_path):
    one = spark.createDataFrame([("a",)], "name string")
    two = spark.createDataFrame([("b",)], "name string")
    assert readers.cache_json(one, f"{tmp_path}/c", "name string").first().name == "a"
    assert readers.cache_json(two, f"{tmp_path}/c", "name string").first().name == "a"


def test_last_of_equal_names_decides_the_category(spark):
    meta = spark.createDataFrame(
        [("x", "kafka", 1), ("x", "pdf", 2)], "name string, description string, position int"
    )
    projects = spark.createDataFrame([("x",), ("y",), (None,)], "repo string")
    got = {r.repo: r.category for r in funnel.category_lookup(projects, meta, "position").collect()}
    assert got == {"x": "Domain-Specific Libraries", "y": None, None: None}


def test_thresholds_read_bad_numbers_as_zero(spark):
    commits = spark.createDataFrame(
        [("r", "a", "x", "1"), ("r", "b", "10", None)],
        "repository string, commit_hash string, total_lines_added string, total_files_count string",
    )
    row = adjust.quantile_thresholds(commits, 0.5, 0.5).first()
    assert (row.thr_lines, row.thr_files) == (5.0, 0.5)


def test_null_keys_are_numbered_and_boxed(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", 2.0), ("a", 5.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    numbered = ranking.number_rows(df, ["g"], ["x"], "n", slices=3).collect()
    assert sorted((str(r.g), r.x, r.n) for r in numbered) == [
        ("None", 1.0, 1), ("None", 2.0, 2), ("None", 3.0, 3), ("a", 2.0, 1), ("a", 5.0, 2)
    ]
    boxes = {r.g: r for r in stats.box_stats(df, ["g"], "x").collect()}
    assert (boxes[None].n, boxes[None].median, boxes[None].mean) == (3, 2.0, 2.0)
    assert boxes["a"].n == 2
