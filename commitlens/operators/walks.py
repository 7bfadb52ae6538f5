"""Walks along edges of which every node has at most one: pointer doubling.

Every node keeps where it gets with 2^k steps; squaring that table takes one join,
so a chain of n nodes ends after log2(n) rounds.  A walk that never ends leads to a
cycle: rounds stop finding ends while walks are left.  Cycles are then what is
still met after ever more steps, and a node before one enters it where a walk over
the edges before cycles ends.  Edges that neither follow nor lead to another edge
are walks of one step and stay out of the rounds.  Trails are put together at the
very end, from the tables of all rounds, in as many joins: a place of the trail is
met from the place 2^k before it, and every place is written once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.session import cut


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _squared(table: DataFrame, moving: Column) -> DataFrame:
    """(repo, src, far, steps) with twice the steps; ``moving`` tells the rows that may go on."""
    ahead = table.select(
        F.col("repo").alias("_repo"), F.col("src").alias("_src"), F.col("far").alias("_far"), F.col("steps").alias("_steps")
    )
    on = moving & (F.col("repo") == F.col("_repo")) & (F.col("far") == F.col("_src"))
    return table.join(ahead, on, "left").select(
        "repo",
        "src",
        F.coalesce("_far", "far").alias("far"),
        (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
        # Ended: no edge leads on, or the node ahead has ended itself.
        (F.col("_src").isNull() | (F.col("_steps") < F.col("steps"))).alias("ended"),
    )


def _doubled(edges: DataFrame) -> list[DataFrame]:
    """(repo, src, far, steps, ended) after 1, 2, 4, ... steps, until a round finds no more ends."""
    table = cut(
        edges.select("repo", "src", F.col("dst").alias("far"), F.lit(1).cast("long").alias("steps"), F.lit(False).alias("ended")),
        "jumps",
    )
    tables, left = [table], table.count()
    while left:
        table = cut(_squared(tables[-1], ~F.col("ended")), "jumps")
        tables.append(table)
        before, left = left, table.where("not ended").count()
        # While any chain is left its next nodes end in every round; none ended: all that is left leads to cycles.
        if left == before:
            break
    return tables


def _parted(edges: DataFrame) -> DataFrame:
    """Edges with ``linked``: whether another edge, or the edge itself, ends where it starts or starts where it ends."""
    starts = edges.select("repo", F.col("src").alias("node"))
    ends = edges.select("repo", F.col("dst").alias("node"))
    between = cut(starts.distinct().join(ends, ["repo", "node"], "left_semi"), "between")

    def met(at: str) -> DataFrame:
        return between.select("repo", F.col("node").alias(at), F.lit(True).alias(f"_{at}"))

    flagged = edges.select("repo", "src", "dst").join(met("src"), ["repo", "src"], "left").join(met("dst"), ["repo", "dst"], "left")
    linked = F.col("_src").isNotNull() | F.col("_dst").isNotNull()
    return cut(flagged.select("repo", "src", "dst", linked.alias("linked")), "edges")


def _on_cycles(endless: DataFrame) -> DataFrame:
    """(repo, node) of the cycles that endless walks lead to: what all of them still meet."""
    table, met = endless.select("repo", "src", "far", "steps"), None
    while True:
        nodes = cut(table.select("repo", F.col("far").alias("node")).distinct(), "met")
        before, met = met, nodes.count()
        if met == before:
            return nodes
        table = cut(_squared(table, F.lit(True)).drop("ended"), "round")


def _cycle_sizes(ring: DataFrame) -> DataFrame:
    """(repo, src, size): nodes on the cycle of each node of ``ring`` (repo, src, far), by its smallest node."""
    table = ring.select("repo", "src", "far", F.least("src", "far").alias("low"))
    while True:
        ahead = table.select(F.col("repo").alias("_repo"), F.col("src").alias("_src"), F.col("far").alias("_far"), F.col("low").alias("_low"))
        table = cut(
            table.join(ahead, (F.col("repo") == F.col("_repo")) & (F.col("far") == F.col("_src"))).select(
                "repo", "src", F.col("_far").alias("far"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("lower")
            ),
            "ring",
        )
        if table.where("lower").isEmpty():
            break
        table = table.drop("lower")
    sizes = table.groupBy("repo", "low").agg(F.count("*").alias("size"))
    return table.join(sizes, ["repo", "low"]).select("repo", "src", "size")


class Walks:
    """Ends and trails of the walks along ``edges`` (repo, src, dst; one edge per src).

    ``ends`` has (repo, src, last, length) for every src: ``last`` is the node
    without an edge that the walk ends at or, on a cycle, the first node met
    twice; ``length`` counts the different nodes met.
    """

    def __init__(self, edges: DataFrame):
        parted = _parted(edges)
        linked = parted.where("linked").drop("linked")
        one = F.lit(1).cast("long")
        single = parted.where("not linked").select(
            "repo", "src", F.col("dst").alias("far"), one.alias("steps"), F.lit(False).alias("ended")
        )
        self.tables = _doubled(linked)
        last = self.tables[-1]
        done = last.where("ended").unionByName(single).select(
            "repo", "src", F.col("far").alias("last"), (F.col("steps") + 1).alias("length")
        )
        self.looped = len(self.tables) > 1 and not last.where("not ended").isEmpty()
        self.ends = _union([done, *self._entries(linked, last.where("not ended"))]) if self.looped else done
        # The first steps of all walks; no longer ones lead from single edges.
        self.tables[0] = self.tables[0].unionByName(single)

    def _entries(self, edges: DataFrame, endless: DataFrame) -> list[DataFrame]:
        cycles = cut(_on_cycles(endless), "cycles")
        src = F.col("node").alias("src")
        ring = edges.join(cycles.select("repo", src), ["repo", "src"]).withColumnRenamed("dst", "far")
        sizes = cut(_cycle_sizes(ring), "sizes")
        own = sizes.select("repo", "src", F.col("src").alias("last"), F.col("size").alias("length"))
        before = edges.join(endless.select("repo", "src"), ["repo", "src"], "left_semi").join(
            cycles.select("repo", src), ["repo", "src"], "left_anti"
        )
        led = _doubled(before)[-1].select("repo", "src", F.col("far").alias("last"), "steps")
        sized = sizes.select(F.col("repo"), F.col("src").alias("last"), "size")
        led = led.join(sized, ["repo", "last"]).select("repo", "src", "last", (F.col("steps") + F.col("size")).alias("length"))
        return [own, led]

    def trails(self, starts: DataFrame) -> DataFrame:
        """(repo, path, last, trail) of each start: all nodes of its walk in order; a start without an edge is all of it."""
        walking = starts.select("repo", "path").join(self.ends.withColumnRenamed("src", "path"), ["repo", "path"])
        walking = cut(walking, "walking")
        most = walking.agg(F.max("length")).first()[0] or 1
        jumps = list(self.tables)
        while 2 ** len(jumps) < most:
            jumps.append(cut(_squared(jumps[-1], ~F.col("ended")), "jumps"))
        zero = F.lit(0).cast("long").alias("pos")
        parts = [walking.select("repo", "path", "length", F.col("path").alias("node"), zero)]
        for k in reversed(range((most - 1).bit_length())):
            jump = jumps[k].where(F.col("steps") == 2**k).select(F.col("repo"), F.col("src").alias("node"), "far")
            further = (
                _union(parts)
                .where(F.col("pos") + 2**k < F.col("length"))
                .join(jump, ["repo", "node"])
                .select("repo", "path", "length", F.col("far").alias("node"), (F.col("pos") + 2**k).alias("pos"))
            )
            parts.append(cut(further, "places"))
        in_order = F.sort_array(F.collect_list(F.struct("pos", "node")))
        trails = _union(parts).groupBy("repo", "path").agg(F.transform(in_order, lambda x: x["node"]).alias("trail"))
        found = walking.select("repo", "path", "last").join(trails, ["repo", "path"])
        return starts.select("repo", "path").join(found, ["repo", "path"], "left").select(
            "repo", "path", F.coalesce("last", "path").alias("last"), F.coalesce("trail", F.array("path")).alias("trail")
        )

    def lasts(self, starts: DataFrame) -> DataFrame:
        """(repo, path, last) of each start."""
        ends = self.ends.select("repo", F.col("src").alias("path"), "last")
        return starts.select("repo", "path").join(ends, ["repo", "path"], "left").withColumn("last", F.coalesce("last", "path"))
