import numpy as np
import pytest
from pyspark.sql import functions as F

from commitlens.llm.q_vectors import op7_vectors
from commitlens.llm.vectors import Index, nearest, rotation, scan

from .helpers import FOLDER


def exact(ids, x, k=20):
    x = np.asarray(x, np.float64)
    out = {}
    for i, q in enumerate(ids):
        if q % 20 == 0:
            score = x @ x[i]
            out[q] = [c for _, c in sorted((-s, c) for s, c in zip(score.tolist(), ids, strict=True) if c != q)][:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.1"])
def test_recall_against_brute_force(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    want = exact([r.vec_id for r in rows], [r.embedding for r in rows])
    got = found(op7_vectors(spark, folder))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def test_all_lists_and_no_early_end_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 6)).round(2) * rng.uniform(0.1, 3, (300, 1)).round(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(df, lambda c: c % 20 == 0, index=Index(lists=5, probes=5, strict=1e9, chunk=40, queries=3))
    assert found(got) == exact(list(range(300)), x)
    for r in got.collect():
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]))


def test_equal_vectors_ties_and_unusable_ones(spark):
    same = [1.0, 2.0]
    rows = [(i, same) for i in range(60)] + [(60, same)] * 3 + [(100, None), (120, [0.0, 0.0]), (140, [float("nan"), 1.0])]
    rows += [(160, [None, 1.0]), (180, [float("inf"), 1.0]), (None, same), (200, [1.0]), (220, [5.0, 5.0]), (221, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).withColumn("id", F.lit(0))
    got = found(nearest(df, lambda c: c % 20 == 0))
    assert set(got) == {0, 20, 40, 60, 220}
    assert got[220] == list(range(20)) and got[0] == [220, *range(1, 20)] and got[20] == [220, *range(19)]
    assert nearest(df.limit(0), lambda c: c % 20 == 0).count() == 0
    few = nearest(df.filter("vec_id in (0, 220)"), lambda c: c % 20 == 0)
    assert found(few) == {0: [220], 220: [0]}


def test_scan_finds_the_nearest_by_partial_distances():
    rng = np.random.default_rng(3)
    rows = rng.standard_normal((5000, 65)) @ rotation(65, 1)
    hits = 0
    for i in range(20):
        want = np.argsort(((rows - rows[i]) ** 2).sum(axis=1))[:20]
        hits += len(set(scan(rows[i], rows, 20, 16, 2.1).tolist()) & set(want.tolist()))
    assert hits >= 0.97 * 400
