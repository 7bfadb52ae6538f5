"""The manifest against whole trees in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from commitlens.llm import merkle
from commitlens.llm.merkle import Shape, manifest
from commitlens.llm.q_merkle import leaves, op13_merkle
from tests.llm.helpers import FOLDER, documents


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(nodes, arity):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([h("".join(found[-1][i : i + arity])) for i in range(0, len(found[-1]), arity)])
    return found


def path(tree, i, arity):
    for level in tree[:-1]:
        start = i - i % arity
        run = level[start : start + arity]
        yield "".join(run[: i - start]), "".join(run[i - start + 1 :])
        i //= arity


def brute(rows, arity=3):
    """(id, source, leaf, changed) to the rows of a manifest."""
    sources = defaultdict(list)
    for row in rows:
        sources[row[1]].append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        sources[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[source] = levels([r[2] for r in sources[source]], arity)
    top = levels([trees[s][-1][0] for s in order], arity)
    out = []
    for k, source in enumerate(order):
        for i, (key, _, leaf, changed) in enumerate(sources[source]):
            steps = [*path(trees[source], i, arity), *path(top, k, arity)]
            now = changed
            for left, right in steps:
                now = h(left + now + right)
            out.append((key, source, leaf, trees[source][-1][0], top[-1][0], "".join(a + b for a, b in steps), now))
    return sorted(out, key=repr)


def rows_of(sizes, seed=1):
    rng = random.Random(seed)
    rows = [(i if rng.random() > 0.05 else None, source, h(f"{source}{i}")) for source, n in sizes.items() for i in range(n)]
    return [(*r, r[2] if rng.random() < 0.5 else h("other" + r[2])) for r in rows]


def made(spark, rows, **shape):
    frame = spark.createDataFrame(rows, "id long, source string, leaf string, changed string").repartition(3)
    return sorted(map(tuple, manifest(frame, Shape(**shape)).collect()), key=repr)


@pytest.mark.parametrize("arity, height", [(3, 6), (3, 1), (2, 2), (4, 1)])
def test_agrees_with_whole_trees(spark, arity, height):
    rows = rows_of({"a": 100, "b": 1, None: 10, "é": 3, "-": 4, "z": 27, "": 28, "hot": 250})
    assert made(spark, rows, arity=arity, height=height) == brute(rows, arity)


def test_many_sources(spark):
    rows = rows_of({f"host{i}": i % 3 + 1 for i in range(60)})
    assert made(spark, rows, height=2) == brute(rows)


@pytest.mark.parametrize("sizes", [{}, {"a": 1}, {None: 1}, {"a": 2}, {"a": 1, "b": 1}])
def test_smallest_trees(spark, sizes):
    rows = rows_of(sizes)
    assert made(spark, rows) == brute(rows)


def test_sweeps():
    for count in range(1, 40):
        nodes = merkle.sweep_up([h(str(i)).encode() for i in range(count)], 3, None)
        chains = merkle.sweep_down(nodes, count, 3, None, ())
        assert {merkle.folded(nodes[i], list(merkle._steps(c))) for i, c in enumerate(chains)} == {nodes[-1]}
        assert [merkle._unpacked(merkle._packed(c)) for c in chains] == chains


def test_equal_ids_and_rows(spark):
    rows = [(1, "a", h(x), h(x)) for x in "cabba"]
    assert made(spark, rows) == brute(rows)


def leaf(doc_id, source, lang, n_chars, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def wanted(docs):
    rows = []
    for r in docs:
        text = r.text
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and text is not None:
            text = text.replace("\n", "")
        fixed = (r.doc_id, r.source, r.lang, r.n_chars)
        rows.append((r.doc_id, r.source, leaf(*fixed, r.text), leaf(*fixed, text)))
    return [(i, own, sub, root, h(proof), now, now == root) for i, _, own, sub, root, proof, now in brute(rows)]


def test_leaves_of_documents(spark):
    rows = [(1, "a\nb", None, "s"), (2, None, "en", None), (3, "", "", ""), (None, "x\n", "é", "s"), (4, "long\n" * 50_000, "en", "s"), (4, "long\n" * 50_000, "en", "s")]
    docs = documents(spark, rows).withColumn("leaf", F.lit("clash")).withColumn("id", F.lit(7))
    found = leaves(docs).collect()
    as_rows = sorted(((r.id, r.source, r.leaf, r.changed) for r in found), key=repr)
    plain = []
    for r in docs.collect():
        text = r.text
        if text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
            text = text.replace("\n", "")
        fixed = (r.doc_id, r.source, r.lang, r.n_chars)
        plain.append((r.doc_id, r.source, leaf(*fixed, r.text), leaf(*fixed, text)))
    assert as_rows == sorted(plain, key=repr)


def test_query_agrees_with_whole_trees(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    found = sorted(map(tuple, op13_merkle(spark, FOLDER).collect()))
    assert found == sorted(wanted(docs))
    assert {r[-1] for r in found} == {True, False}
