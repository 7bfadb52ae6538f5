import pytest
from pyspark.sql import functions as F

from commitlens.llm import q_quality
from commitlens.llm.quality import Rules, bin_of, quality, repeated_words, well_made

from .helpers import FOLDER, documents, duck, same_rows


def covered(words):
    found = {}
    for i in range(len(words) - 2):
        found.setdefault(tuple(words[i : i + 3]), []).append(i)
    return len({i + k for p in found.values() if len(p) > 1 for i in p for k in range(3)})


def test_repeated_words_against_sets(spark):
    texts = ["", "a", "a b", "a b c", "a a a a", "a b c d a b c", "a b c a b c a b", "x y z q x y z y z q x y", "a b a b a"]
    df = spark.createDataFrame([(t, [w for w in t.split(" ") if w]) for t in texts], "t string, w array<string>")
    for r in df.select("w", repeated_words(F.col("w")).alias("n")).collect():
        assert r.n == covered(r.w), r.w


def test_bins_are_exact_up_to_63_and_ordered(spark):
    got = [r.b for r in spark.range(5000).select(bin_of(F.col("id")).alias("b")).collect()]
    assert got[:64] == list(range(64))
    assert all(b <= v and 32 * (v - b) < max(v, 1) for v, b in enumerate(got)) and got == sorted(got)


def test_query_against_sql(spark):
    same_rows(q_quality.op2_quality(spark, FOLDER), duck(FOLDER), q_quality.SQL)


@pytest.fixture(scope="module")
def docs(spark):
    good = " ".join(f"w{i}rd{i * 7}" for i in range(60))
    junk = " ".join(f"w{i}%%%" for i in range(60))
    lines = "\n".join(["again and again this is it"] + ["again and again this is it"] * 3) + good
    rows = [(i, good) for i in range(8)] + [(10, junk), (11, None), (12, ""), (13, " \n "), (14, "few words"), (15, "a b c " * 40)]
    rows += [(16, good, None, None), (17, junk, None, None), (None, good), (0, good), (18, lines)]
    return documents(spark, rows).withColumn("kept", F.lit(1))


def test_verdicts(docs):
    found = quality(docs, rules=Rules(least_docs=3))
    assert found.columns[-1] == "kept_"
    kept = {}
    for r in found.collect():
        kept.setdefault(r.doc_id, []).append(r.kept_)
    assert kept[0] == [True, True] and kept[None] == [True]
    assert all(kept[i] == [True] for i in (*range(1, 8), 16))
    assert all(kept[i] == [False] for i in (10, 11, 12, 13, 14, 15, 17))


def test_kept_rows_keep_their_columns(docs):
    found = well_made(docs)
    assert found.columns == docs.columns
    ids = [r.doc_id for r in found.collect()]
    assert sorted(x for x in ids if x is not None) == [0, 0, 1, 2, 3, 4, 5, 6, 7, 16, 18] or 18 not in ids


def test_empty_table(spark, docs):
    assert quality(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    text = " ".join(f"word{i}" for i in range(200_000))
    row = quality(documents(spark, [(1, text), (2, text + " " + text)])).orderBy("doc_id").collect()
    assert (row[0].n_words, row[0].n_repeat_words) == (200_000, 0)
    assert (row[1].n_words, row[1].n_repeat_words) == (400_000, 400_000)
