"""Walks by pointer doubling against walks step by step."""

import random

import pytest

from commitlens.operators import walks
from commitlens.operators.walks import Walks

EDGES, STARTS = "repo string, src string, dst string", "repo string, path string"


def walk(start, edges):
    trail = [start]
    while trail[-1] in edges and edges[trail[-1]] not in trail:
        trail.append(edges[trail[-1]])
    return edges.get(trail[-1], trail[-1]), trail


def check(spark, edges, starts):
    frame = spark.createDataFrame([("r", a, b) for a, b in edges.items()], EDGES)
    begin = spark.createDataFrame([("r", s) for s in starts], STARTS)
    made = Walks(frame)
    got = {r.path: (r["last"], r.trail) for r in made.trails(begin).collect()}
    assert got == {s: walk(s, edges) for s in starts}
    assert {r.path: r["last"] for r in made.lasts(begin).collect()} == {s: walk(s, edges)[0] for s in starts}
    return made


def test_a_chain_of_a_thousand_takes_few_rounds(spark):
    edges = {f"n{i}": f"n{i + 1}" for i in range(1000)}
    made = check(spark, edges, ["n0", "n1", "n500", "n999", "n1000"])
    assert len(made.tables) <= 11


def test_a_cycle_with_a_long_tail(spark):
    edges = {f"t{i}": f"t{i + 1}" for i in range(100)} | {"t100": "c0"} | {f"c{i}": f"c{(i + 1) % 70}" for i in range(70)}
    made = check(spark, edges, ["t0", "t99", "c0", "c33", "away"])
    assert made.looped and len(made.tables) <= 11


def test_only_cycles(spark):
    check(spark, {"a": "a"}, ["a", "b"])
    check(spark, {"a": "b", "b": "a", "x": "y", "y": "z", "z": "x"}, ["a", "b", "x", "z"])


def test_a_large_cycle_alone(spark):
    check(spark, {f"c{i}": f"c{(i + 1) % 41}" for i in range(41)}, ["c0", "c40", "c7"])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(60)]
    edges = {n: rng.choice(nodes) for n in nodes if rng.random() < (0.7, 0.95, 1)[seed - 1]}
    check(spark, edges, nodes)


def test_repositories_do_not_mix(spark):
    frame = spark.createDataFrame([("r", "a", "b"), ("s", "b", "c"), ("s", "c", "b")], EDGES)
    starts = spark.createDataFrame([("r", "a"), ("s", "a"), ("s", "b")], STARTS)
    got = {(r.repo, r.path): (r["last"], r.trail) for r in Walks(frame).trails(starts).collect()}
    assert got == {("r", "a"): ("b", ["a", "b"]), ("s", "a"): ("a", ["a"]), ("s", "b"): ("b", ["b", "c"])}


def test_no_edges_and_no_starts(spark):
    none = spark.createDataFrame([], EDGES)
    starts = spark.createDataFrame([("r", "a")], STARTS)
    assert [tuple(r) for r in Walks(none).trails(starts).collect()] == [("r", "a", "a", ["a"])]
    edges = spark.createDataFrame([("r", "a", "b")], EDGES)
    assert Walks(edges).trails(starts.limit(0)).count() == 0
    assert walks.Walks(none).looped is False


def test_single_edges_stay_out_of_the_rounds(spark):
    edges = {f"a{i}": f"b{i}" for i in range(50)} | {"c0": "c1", "c1": "c2", "s": "s"}
    made = check(spark, edges, ["a0", "b0", "a49", "c0", "c1", "s"])
    assert [t.where("steps > 0 and src like 'a%'").count() for t in made.tables[1:]] == [0] * (len(made.tables) - 1)
