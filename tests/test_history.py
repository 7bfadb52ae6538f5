"""History rebuilt against a small sequential model on random changes."""

import random

import pytest
from pyspark.sql import functions as F

from commitlens import schemas
from commitlens.operators import history, matching
from commitlens.plans import mining


def changes_frame(spark, rows):
    """Rows of (repo, commit, kind, old, new, lines); commits are days."""
    full = []
    for i, (repo, commit, kind, old, new, lines) in enumerate(rows):
        full.append((repo, commit, i, f"{repo}-c{commit:04d}", f"2020-01-01 00:{commit:02d}:00",
                     "ann", kind, old, new, lines))
    text = schemas.FILE_CHANGES.replace("timestamp", "string")
    df = spark.createDataFrame(full, text)
    return df.withColumn("commit_date", F.to_timestamp("commit_date"))


def random_rows(seed, repos=3, commits=25, paths=9):
    rng = random.Random(seed)
    names = [f"src/main/java/p/F{i}.java" for i in range(paths)]
    rows = []
    for repo in range(repos):
        for commit in range(1, commits + 1):
            for _ in range(rng.randint(1, 4)):
                kind = rng.choice(["ADD", "ADD", "RENAME", "DELETE", "MODIFY"])
                old, new = rng.sample(names, 2)
                rows.append((
                    f"r{repo}", commit, kind,
                    None if kind == "ADD" else old,
                    None if kind == "DELETE" else (old if kind == "MODIFY" else new),
                    rng.randint(0, 50),
                ))
    return rows


class Model:
    """One repository, read event by event."""

    def __init__(self, rows, repo):
        self.timeline, self.fwd, self.back, self.added = {}, {}, {}, set()
        for i, (r, commit, kind, old, new, lines) in enumerate(rows):
            if r != repo:
                continue
            if kind == "RENAME":
                self.fwd[old], self.back[new] = new, old
            elif kind == "ADD":
                self.added.add(new)
                self.timeline.setdefault(new, []).append(("ADD", i, lines))
            elif kind == "DELETE":
                self.timeline.setdefault(old, []).append(("DELETE", i, None))

    def walk(self, start, edges):
        trail, cur = [start], start
        while cur in edges:
            cur = edges[cur]
            if cur in trail:
                break
            trail.append(cur)
        return cur, trail

    def addition(self, path):
        events = self.timeline.get(path, [])
        adds = [e for e in events if e[0] == "ADD"]
        gone = max((e[1] for e in events if e[0] == "DELETE"), default=-1)
        late = [e for e in adds if e[1] > gone]
        return (late or adds or [None])[0]

    def files(self):
        found = {}
        for original in {self.walk(p, self.back)[0] for p in self.added}:
            final, ahead = self.walk(original, self.fwd)
            behind = self.walk(original, self.back)[1]
            chain = ahead + [p for p in behind if p not in ahead]
            adds = [a for a in map(self.addition, chain) if a]
            if adds:
                key = (adds[0][1], original)
                if final not in found or found[final][0] < key:
                    found[final] = (key, adds[0][2], chain)
        return found

    def deleted(self, path):
        events = self.timeline.get(path, [])
        return bool(events) and events[-1][0] == "DELETE" and path not in self.fwd


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_files_agree_with_sequential_reading(spark, seed):
    rows = random_rows(seed)
    changes = changes_frame(spark, rows)
    files = history.build_files(changes, history.commit_stats(changes)).collect()
    for repo in ("r0", "r1", "r2"):
        model = Model(rows, repo)
        want = {
            path: (key[1] if key[1] != path else None, key[0], lines, model.deleted(path),
                   [p.rsplit("/", 1)[-1][:-5] for p in chain])
            for path, (key, lines, chain) in model.files().items()
        }
        got = {
            f.path: (f.original_path, f.change_seq, f.file_lines, f.is_deleted, f.class_names)
            for f in files
            if f.repo == repo
        }
        assert got == want


def test_events_and_commit_totals(spark):
    rows = [
        ("r", 1, "ADD", None, "a/generated/X.java", 5),
        ("r", 1, "ADD", None, "generated/X.java", 7),
        ("r", 1, "ADD", None, "readme.md", 11),
        ("r", 1, None, None, "Y.java", 13),
        ("r", 2, "RENAME", "A.java", "A.txt", 1),
        ("r", 2, "RENAME", "B.txt", "B.java", None),
        ("r", 2, "DELETE", "a/target/C.java", None, 0),
        ("r", 2, "MODIFY", "D.java", "D.java", 2),
        ("r", 2, "COPY", "D.java", "E.java", 2),
    ]
    changes = changes_frame(spark, rows)
    events = {(e.type, e.path) for e in history.file_events(changes).collect()}
    assert events == {
        ("ADD", "generated/X.java"), ("RENAME", "B.java"), ("DELETE", "a/target/C.java"),
    }
    totals = {
        r.commit_hash: (r.total_lines, r.files_count, r.java_files_count)
        for r in history.commit_stats(changes).collect()
    }
    assert totals == {"r-c0001": (36, 4, 2), "r-c0002": (5, 5, 5)}


def test_unknown_author(spark):
    changes = changes_frame(spark, [("r", 1, "ADD", None, "A.java", 1)])
    changes = changes.withColumn("author", F.lit(None).cast("string"))
    assert history.commit_stats(changes).first().author == "Unknown"
    assert history.file_events(changes).first().author == "Unknown"


def test_select_changes(spark):
    changes = changes_frame(spark, random_rows(4))
    firsts = history.select_changes(changes, max_commits=3)
    assert {r[0] for r in firsts.select("commit_seq").distinct().collect()} == {1, 2, 3}
    window = history.select_changes(
        changes, repos=["r1"], since="2020-01-01 00:05:00", to="2020-01-01 00:06:00"
    )
    assert {tuple(r) for r in window.select("repo", "commit_seq").distinct().collect()} == {
        ("r1", 5), ("r1", 6),
    }


def known_changes():
    p, q = "m/src/main/java/o/a/c/", "m/src/test/java/o/a/c/"
    return [
        ("r", 1, "ADD", None, p + "FileUtils.java", 10),
        ("r", 1, "ADD", None, p + "Kept.java", 10),
        ("r", 2, "ADD", None, q + "FileUtilsTest.java", 5),
        ("r", 2, "ADD", None, q + "FileUtilsCopyTest.java", 5),
        ("r", 2, "ADD", None, q + "FileTestCase.java", 5),
        ("r", 3, "ADD", None, q + "LateThingTest.java", 5),
        ("r", 4, "ADD", None, p + "LateThing.java", 5),
        ("r", 5, "ADD", None, "n/src/test/java/x/KeptTest.java", 5),
        ("r", 5, "ADD", None, q + "OrphanThingTest.java", 5),
        ("r", 6, "ADD", None, p + "Both.java", 5),
        ("r", 6, "ADD", None, q + "BothTest.java", 5),
        ("r", 7, "DELETE", q + "BothTest.java", None, 0),
        ("only", 1, "ADD", None, q + "AloneTest.java", 5),
    ]


def test_pairs_and_summary(spark):
    analysis = mining.analyze(changes_frame(spark, known_changes()))
    pairs = {
        p.test_class: (p.prod_class, p.classification, p.match_method, p.pair_status)
        for p in analysis.pairs.collect()
    }
    same, different = "exact_class_same_package", "exact_class_different_package"
    assert pairs == {
        "FileUtilsTest": ("FileUtils", "PRODUCTION_FIRST", same, "ACTIVE"),
        "FileUtilsCopyTest": ("FileUtils", "PRODUCTION_FIRST", same, "ACTIVE"),
        "LateThingTest": ("LateThing", "TEST_FIRST", same, "ACTIVE"),
        "KeptTest": ("Kept", "PRODUCTION_FIRST", different, "ACTIVE"),
        "BothTest": ("Both", "SAME_COMMIT", same, "TEST_DELETED"),
    }
    assert [u.test_class for u in analysis.unmatched.collect()] == ["OrphanThingTest"]
    rows = {s.repo: s for s in analysis.summary.collect()}
    r = rows["r"]
    assert (r.total_commits, r.test_files_added, r.test_helpers, r.prod_files_added) == (7, 7, 1, 4)
    assert (r.matched_pairs, r.multi_test_prods, r.unmatched_test_files) == (5, 1, 1)
    assert (r.unmatched_prod_files, r.active_pairs, r.test_deleted_pairs) == (0, 4, 1)
    assert r.match_rate_pct == 5 / 6 * 100
    alone = rows["only"]
    assert (alone.test_files_added, alone.unmatched_test_files, alone.match_rate_pct) == (1, 0, 0)


def test_result_does_not_depend_on_row_order(spark):
    changes = changes_frame(spark, random_rows(5) + known_changes())
    first = mining.analyze(changes).summary.orderBy("repo").collect()
    shuffled = changes.orderBy(F.rand(1)).repartition(7)
    assert mining.analyze(shuffled).summary.orderBy("repo").collect() == first


def test_invariants_of_matching(spark):
    analysis = mining.analyze(changes_frame(spark, known_changes()))
    total = mining.global_totals(analysis.summary).first()
    assert total.matched_pairs == (
        total.test_first_count + total.same_commit_count + total.prod_first_count
    )
    assert total.matched_pairs == total.active_pairs + total.deleted_pairs
    tests = analysis.files.where("is_test and not is_helper and repo = 'r'").count()
    assert tests == analysis.pairs.count() + analysis.unmatched.count()


def test_popular_class_does_not_spell_out_its_pairs(spark):
    """4,000 tests and 4,000 production files of one class name."""
    n = 4000
    prods = spark.range(n).selectExpr(
        "concat('m/src/main/java/o/a/p', id, '/Hot.java') as new_path", "id as change_seq"
    )
    tests = spark.range(n).selectExpr(
        "concat('m/src/test/java/o/a/p', id + 2000, '/HotTest.java') as new_path",
        "id + 10000 as change_seq",
    )
    changes = prods.unionByName(tests).selectExpr(
        "'r' as repo", "1L as commit_seq", "change_seq", "'c' as commit_hash",
        "timestamp '2020-01-01' as commit_date", "'ann' as author", "'ADD' as change_type",
        "cast(null as string) as old_path", "new_path", "1L as added_lines",
    )
    analysis = mining.analyze(changes)
    assert matching.candidate_matches(analysis.files).count() <= 3 * n
    methods = analysis.matches.groupBy("method").count().orderBy("method").collect()
    # p2000 to p3999 share a package; the others fall back on the first file.
    assert [tuple(r) for r in methods] == [(0, 2000), (2, 2000)]
    far = analysis.matches.where("method = 2").select("prod_file").distinct().collect()
    assert [r[0] for r in far] == ["m/src/main/java/o/a/p0/Hot.java"]


def test_no_step_of_a_history_sorts_to_aggregate(spark):
    events = history.file_events(changes_frame(spark, random_rows(4)))
    forward = history.rename_edges(events, "forward")
    steps = (
        history.effective_additions(events),
        history.deletions(events, forward),
        forward,
        history.rename_edges(events, "backward"),
        history.commit_stats(changes_frame(spark, random_rows(4))),
    )
    for step in steps:
        assert "SortAggregate" not in step._jdf.queryExecution().toString()


def test_two_spellings_of_an_author_are_one_commit(spark):
    rows = changes_frame(spark, [("r", 1, "ADD", None, "a/X.java", 5), ("r", 1, "ADD", None, "a/Y.java", 7)])
    rows = rows.withColumn("author", F.when(F.col("new_path") == "a/X.java", "Ann").otherwise("ann"))
    (stats,) = history.commit_stats(rows).collect()
    assert (stats.author, stats.total_lines, stats.files_count, stats.java_files_count) == ("Ann", 12, 2, 2)


def test_files_shuffle_few_wide_rows(spark):
    """Looked-up columns lie by path: neither additions nor deletions are shuffled by their order again."""
    events = history.file_events(changes_frame(spark, random_rows(4)))
    forward = history.rename_edges(events, "forward")
    for step in (history.effective_additions(events), history.deletions(events, forward), forward):
        plan = step._jdf.queryExecution().executedPlan().toString()
        exchanges = [x for x in plan.split("\n") if "hashpartitioning(" in x]
        assert exchanges
        assert not [x for x in exchanges if "_at" in x.split("hashpartitioning(")[1].split(")")[0]]


def test_a_settled_test_offers_no_other_keys(spark):
    """Of two production files the older lies elsewhere; the first candidate in the package of the test stands."""
    p, q = "m/src/main/java/o/a/c/", "m/src/test/java/o/a/c/"
    rows = [
        ("r", 1, "ADD", None, "n/src/main/java/x/Thing.java", 1),
        ("r", 2, "ADD", None, p + "Thing.java", 1),
        ("r", 3, "ADD", None, q + "ThingTest.java", 1),
        ("r", 3, "ADD", None, "k/src/test/java/y/ThingTest.java", 1),
        ("r", 4, "ADD", None, q + "NoneSuchTest.java", 1),
    ]
    matches = mining.analyze(changes_frame(spark, rows)).matches.collect()
    assert {(m.test_file, m.prod_file, m.method) for m in matches} == {
        (q + "ThingTest.java", p + "Thing.java", 0),
        ("k/src/test/java/y/ThingTest.java", "n/src/main/java/x/Thing.java", 2),
    }
