import random

import pytest
from pyspark.sql import functions as F

from commitlens.llm import q_mixing
from commitlens.llm.mixing import mix, mixed, targets

from .helpers import FOLDER, documents, duck, same_rows


def shared(sizes, weights=(5, 2, 1), most=3):
    """Targets by giving the excess to the rest again and again."""
    names = sorted(sizes, key=lambda x: (x is None, x))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    goal, left, rest = {}, float(sum(sizes.values())), set(names)
    while rest:
        total = sum(weight[n] for n in rest)
        over = {n for n in rest if left * weight[n] / total > most * sizes[n]}
        if not over:
            return goal | {n: left * weight[n] / total for n in rest}
        goal |= {n: float(most * sizes[n]) for n in over}
        left -= sum(most * sizes[n] for n in over)
        rest -= over
    return goal


@pytest.mark.parametrize("seed", range(4))
def test_targets_against_repeated_sharing(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 10, 1000, 50_000]) for i in range(9)} | {None: 70}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in targets(df, (5, 2, 1), 3).collect()}
    assert got == pytest.approx(shared(sizes))


def test_query_against_sql(spark):
    same_rows(q_mixing.op10_mixing(spark, FOLDER), duck(FOLDER), q_mixing.SQL)


def test_taken_words_come_near_and_nested(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 40), "en", rng.choice("aaaaaaabbc")) for i in range(3000)]
    docs = documents(spark, rows)
    found = mix(docs).collect()
    by = {}
    for r in found:
        by.setdefault(r.source, []).append(r)
        assert r.taken <= 3 * r.size
    for rs in by.values():
        assert sum(r.size for r in rs) == rs[0].source_size
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 20
    again = mix(docs.orderBy(F.rand(1)).repartition(7)).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in found}
    rows_out = mixed(docs).groupBy("doc_id").count().collect()
    assert {(r.doc_id, r["count"]) for r in rows_out if r["count"]} >= {(r.doc_id, r.taken // r.size) for r in found if r.taken}


def test_nulls_ties_empty_and_clashing(spark):
    rows = [(1, None, "en", "a"), (None, "x y", "en", None), (None, "x", "en", None), (3, "", "en", "b"), (4, "w " * 9, "en", "a"), (4, "w " * 9, "en", "a")]
    docs = documents(spark, rows).withColumn("size", F.lit("own")).withColumn("taken", F.lit("t"))
    found = mix(docs)
    assert found.columns[-5:-1] == ["size_", "source_size", "target", "taken_"]
    got = found.collect()
    assert len(got) == 6 and all(r.taken_ <= 3 * r.size_ for r in got)
    assert {r.source_size for r in got if r.source is None} == {3}
    assert {r.target for r in got if r.source == "b"} == {0.0}
    assert mixed(docs).columns == docs.columns
    assert mix(docs.limit(0)).count() == 0
    assert {r.target for r in mix(documents(spark, [(1, ""), (2, None)])).collect()} == {0.0}
