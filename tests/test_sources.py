"""Stored layout, validation, published copies, broken CSV and parts of several layouts."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from commitlens.operators import matching, validation
from commitlens.plans import mining
from commitlens.sources import layout, readers, writers

CHANGES = """repo string, commit_seq bigint, change_seq bigint, commit_hash string, commit_date timestamp,
    author string, change_type string, old_path string, new_path string, added_lines bigint"""


def changes(spark, repos=3, commits=4):
    rows = spark.range(repos * commits).selectExpr(
        f"concat('r', id % {repos}) as repo", f"id div {repos} as commit_seq", "id as change_seq",
        "md5(cast(id as string)) as commit_hash", "timestamp '2020-01-01' + make_interval(0, 0, 0, cast(id as int)) as commit_date",
        "'me' as author", "'ADD' as change_type", "cast(null as string) as old_path",
        "concat('src/', if(id % 2 = 0, 'main', 'test'), '/java/a/Thing', id div 2, if(id % 2 = 0, '', 'Test'), '.java') as new_path",
        "id as added_lines",
    )
    return spark.createDataFrame(rows.collect(), CHANGES)


def scan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_history_prunes_folders_and_row_groups(spark, tmp_path):
    path = str(tmp_path / "history")
    table = changes(spark, repos=20, commits=50)
    layout.write_history(table, path, buckets=8)
    back = layout.read_history(spark, path, buckets=8)
    assert sorted(map(tuple, back.select(table.columns).collect()), key=repr) == sorted(map(tuple, table.collect()), key=repr)
    some = layout.read_history(spark, path, ["r3", "r17", "away"], since="2020-02-01", to="2020-12-31", buckets=8)
    plan = scan_of(some)
    folders = plan.split("PartitionFilters: [")[1].split("]")[0]
    pushed = plan.split("PushedFilters: [")[1].split("], ReadSchema")[0]
    assert layout.BUCKET in folders and "In(repo, [" in pushed and "GreaterThanOrEqual(commit_date" in pushed
    wanted = table.where("repo in ('r3', 'r17') and commit_date between '2020-02-01' and '2020-12-31'")
    assert sorted(r.change_seq for r in some.collect()) == sorted(r.change_seq for r in wanted.collect())


def test_a_hot_repository_fills_many_files(spark, tmp_path):
    path = str(tmp_path / "hot")
    layout.write_history(changes(spark, repos=1, commits=400), path, buckets=8)
    (bucket,) = [f for f in os.listdir(path) if f.startswith(layout.BUCKET)]
    assert len([f for f in os.listdir(f"{path}/{bucket}") if f.endswith(".parquet")]) == 4


def test_unknown_repository_is_an_error(spark):
    table = spark.createDataFrame([("a", 1)], "repository string, n int")
    assert layout.one_repository(table, "a").count() == 1
    with pytest.raises(ValueError, match="'b'"):
        layout.one_repository(table, "b")


def test_failed_repositories_leave_the_rest_alone(spark, tmp_path):
    good = changes(spark)
    bad = good.withColumn("repo", F.concat(F.lit("bad_"), "repo")).withColumns(
        {
            "commit_hash": F.when(~F.expr("repo = 'bad_r0' and commit_seq = 2"), F.col("commit_hash")),
            "change_seq": F.when(~F.expr("repo in ('bad_r0', 'bad_r1') and commit_seq = 1"), F.col("change_seq")),
        }
    )
    two = good.where("repo = 'r2'").withColumn("repo", F.lit("two"))
    two = two.unionByName(two.limit(1).withColumn("author", F.lit("you")))
    nobody = good.limit(1).withColumn("repo", F.lit(None).cast("string"))
    every = good.unionByName(bad.where("repo <> 'bad_r2'")).unionByName(two).unionByName(nobody)
    failed, seen = validation.failed_repositories(every)
    assert {tuple(r) for r in failed.collect()} == {
        ("bad_r0", "a change has no commit hash", 2),
        ("bad_r1", "a change has no place in its commit", 1),
        ("two", "a commit has two authors", 1),
    }
    assert seen == {"rows": every.count(), "faulty": 3}
    analysis = mining.analyze(every)
    alone = mining.analyze(good)
    assert alone.failed.count() == 0
    assert analysis.summary.orderBy("repo").collect() == alone.summary.orderBy("repo").collect()
    folder = str(tmp_path / "out")
    writers.write_analysis(folder, analysis, with_unmatched=False)
    lines = [r.value for r in spark.read.text(f"{folder}/summary").collect()]
    assert sum(line.startswith("two,ERROR,a commit has two authors,") for line in lines) == 1
    assert len([line for line in lines if "ERROR" in line]) == 3
    totals = spark.read.json(f"{folder}/report_totals").first()
    assert (totals.total_repositories, totals.successfully_analyzed) == (6, 3)
    assert totals.aggregate_statistics.total_matched_pairs == analysis.pairs.count()
    assert spark.read.json(f"{folder}/report").count() == 3
    assert not os.path.exists(f"{folder}/unmatched")


def test_totals_of_nothing(spark):
    analysis = mining.analyze(changes(spark).limit(0))
    totals = writers.report_totals(analysis.report, analysis.failed).first()
    assert (totals.total_repositories, totals.successfully_analyzed, totals.aggregate_statistics) == (0, 0, None)


def test_scan_bounds_of_an_analysis(spark):
    table = changes(spark)
    assert [r.repo for r in mining.analyze(table, repos=["r1"], max_commits=2).summary.collect()] == ["r1"]
    assert mining.analyze(table, repos=["r1"], max_commits=2).commits.count() == 2
    assert mining.analyze(table, since="2020-01-10").commits.count() == 3


def test_matching_and_files_hash_aggregate(spark):
    analysis = mining.analyze(changes(spark))
    for df in (matching.candidate_matches(analysis.files), matching.best_matches(analysis.files)):
        assert "SortAggregate" not in df._jdf.queryExecution().toString()


META = "name string, size bigint"


def test_a_broken_first_write_is_never_read(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], META)
    broken = rows.withColumn("size", F.when(F.col("name") == "a", F.col("size")).otherwise(F.raise_error(F.lit("lost")).cast("bigint")))
    with pytest.raises(Exception, match="lost"):
        readers.cache_json(broken, path, META)
    assert readers.published(spark, path) is None
    with pytest.raises(FileNotFoundError):
        readers.read_published(spark, path, META)
    os.makedirs(f"{path}/copy-half")
    with open(f"{path}/copy-half/part-0.json", "w") as f:
        f.write('{"name": "half", "size": 9}\n')
    assert {r.name for r in readers.cache_json(rows, path, META).collect()} == {"a", "b"}
    # Another writer comes too late.
    assert {r.name for r in readers.cache_json(rows.limit(0), path, META).collect()} == {"a", "b"}
    assert readers.publish(spark, path, "copy-half") == readers.published(spark, path) != f"{path}/copy-half"


def test_readers_wait_for_the_mark(spark, tmp_path):
    path = str(tmp_path / "late")
    rows = spark.createDataFrame([("a", 1)], META)

    def later():
        time.sleep(1)
        readers.cache_json(rows, path, META)

    writer = threading.Thread(target=later)
    writer.start()
    assert readers.read_published(spark, path, META, seconds=60).count() == 1
    writer.join()


def test_broken_csv_records_become_errors(spark, tmp_path):
    (tmp_path / "short.csv").write_text('id,text,size\n1,one,10\n2,two\n3,"line\nbreak, and ""quote""",30\nx,four,40\n')
    (tmp_path / "quote.csv").write_text('id,text,size\n5,five,50\n6,"six,60\n7,seven,70\n')
    rows, errors = readers.scan_csv_checked(
        spark, [str(tmp_path / "short.csv"), str(tmp_path / "quote.csv")], "id bigint, text string, size bigint"
    )
    assert {tuple(r) for r in rows.collect()} == {(1, "one", 10), (3, 'line\nbreak, and "quote"', 30), (5, "five", 50)}
    found = [(r.file.rsplit("/", 1)[-1], r.record.split(",")[0]) for r in errors.collect()]
    assert sorted(found)[:1] == [("quote.csv", "6")] and {("short.csv", "2"), ("short.csv", "x")} <= set(found)


def test_text_survives_csv(spark, tmp_path):
    texts = ["a\nb", 'q"uo"te', ' lead, trail ', "x\ty", "é\n\n", "\"", ","]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    writers.write_csv(df, str(tmp_path / "out"))
    rows, errors = readers.scan_csv_checked(spark, str(tmp_path / "out"), "id int, text string")
    assert errors.count() == 0
    assert [r.text for r in rows.orderBy("id").collect()] == texts


def test_many_parts_of_two_layouts_take_two_reads(spark, tmp_path):
    paths = []
    for i in range(500):
        header, row = (("id,name,size", f"{i},n{i},{i * 2}"), ("size,other,id", f"{i * 2},o,{i}"))[i % 2]
        path = tmp_path / f"part{i}.csv"
        path.write_text(f"{header}\n{row}\n")
        paths.append(str(path))
    table = readers.scan_csv_by_name(spark, paths, "id bigint, name string, size int")
    assert table.columns == ["id", "name", "size"]
    assert table._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2
    assert {tuple(r) for r in table.collect()} == {(i, None if i % 2 else f"n{i}", i * 2) for i in range(500)}
