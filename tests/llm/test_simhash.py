import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from commitlens.llm import simhash
from commitlens.llm.common import connected
from commitlens.llm.q_simhash import op1_simhash

from .helpers import FOLDER, brute_components, documents


def plain_fingerprint(text, k=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="aB cÉ\n\t \x1c", max_size=60))
def test_fingerprint_as_defined(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_hash_is_that_of_spark(spark):
    text = "Grüße an alle hier"
    want = xxhash.xxh64_intdigest(text.encode(), 42)
    got = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    assert got % 2**64 == want


@pytest.mark.parametrize("distance,segments", [(0, 1), (1, 2), (2, 3), (3, 2), (4, 3), (4, 2), (4, 4), (5, 3)])
def test_plan_meets_every_pair(distance, segments):
    plan = simhash.segment_plan(distance, segments)
    rng = random.Random(1)
    for _ in range(300):
        change = sum(1 << b for b in rng.sample(range(64), distance))
        assert any(bin(change >> low & ((1 << bits) - 1)).count("1") <= r for low, bits, r in plan)


def test_every_change_of_two_bits_is_met():
    plan = simhash.segment_plan(2, 3)
    for a, b in combinations(range(64), 2):
        change = 1 << a | 1 << b
        assert any(bin(change >> low & ((1 << bits) - 1)).count("1") <= r for low, bits, r in plan)


def test_components_against_all_pairs(spark):
    rng = random.Random(7)
    bases = [rng.getrandbits(64) for _ in range(40)]
    prints = set(bases)
    for base in bases:
        for _ in range(6):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    prints |= {0, 1, 2**64 - 1, 2**63, 2**63 | 15}
    nodes = sorted(np.array(sorted(prints), dtype=np.uint64).view(np.int64).tolist())
    want = brute_components(nodes, lambda a, b: ((a ^ b) % 2**64).bit_count() <= 4)
    df = spark.createDataFrame([(n,) for n in nodes], "fp long")
    got = {n: n for n in nodes} | {r.node: r.root for r in connected(simhash.fingerprint_links(df, 4, 3)).collect()}
    assert got == want


def test_exploded_fingerprints_are_not_broadcast(spark):
    # However small Spark takes the table to be: 45 lookups a fingerprint do not show in its size.
    links = simhash.fingerprint_links(spark.createDataFrame([(n,) for n in range(9)], "fp long"), 4, 3)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_long_chain_is_one_component(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 500), (700, 600)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(201), 0) | {600: 600, 700: 600}


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One TWO"), (6, "one three"), (None, "one two"), (4, "one two")]
    docs = documents(spark, rows).withColumn("fingerprint", F.lit("own")).withColumn("component_id", F.lit(0))
    found = simhash.near_duplicates(docs)
    assert found.columns[-3:] == ["fingerprint_", "group", "component_id_"]
    got = sorted(((r.doc_id, r.component_id_) for r in found.collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (None, 4), (4, 4)], key=str)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6]


def test_empty_table_and_ids_that_are_all_null(spark):
    assert simhash.near_duplicates(documents(spark, []).limit(0)).count() == 0
    docs = documents(spark, [(None, "a b c d e"), (None, "a b c d e"), (None, "x y z")])
    assert simhash.one_of_each(docs).count() == 2


def test_query_against_all_pairs(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = brute_components(sorted(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    rows = op1_simhash(spark, FOLDER).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert len(set(want.values())) < len(want)
