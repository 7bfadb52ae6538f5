"""Merkle manifest of a table: a tree per source, a tree over the sources, and a proof per row.

Trees are worked out by time-forward processing.  A node's label is its place in
the order of the work, children before parents.  A priority queue ordered by
label holds what has been sent to nodes that have not had their turn: a node
takes its children's digests from the front and sends its own digest to its
parent.  The sweep back goes from the last label to the first: a node takes the
proof that leads from it to the root and sends each child that proof with the
child's own siblings before it, until proofs reach the leaves.

The queue is external in two steps.  A block of ``3 ** height`` consecutive nodes
of a tree is swept in memory; what goes from one block to another goes through a
shuffle that is sorted by label (and spills).  A round turns blocks into single
nodes, so a tree of n nodes takes log n / log(block) rounds, and neither a tree nor
a level of it ever meets in one task.  Every round ends in a written table.

Proofs travel as whole lists of siblings only between blocks, one per block; rows
take theirs inside the sweep, which also folds it, so no proof is ever stored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitlens.llm.common import BATCH_ROWS, cut, prepared

#: Siblings on the left and on the right of a node, as hexadecimal text.
Step = tuple[bytes, bytes]
NODES = pa.schema([("tree", pa.string()), ("size", pa.int64()), ("pos", pa.int64()), ("digest", pa.binary())])
STEPS = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("steps", pa.binary()), ("subroot", pa.binary()), ("root", pa.binary())])


@dataclass(frozen=True)
class Shape:
    """``arity``: nodes of a run; ``height``: levels of a block, swept in memory."""

    arity: int = 3
    height: int = 6

    @property
    def block(self) -> int:
        return self.arity**self.height


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def _widths(count: int, arity: int, levels: int | None) -> list[int]:
    """Nodes of each level over ``count`` leaves: of ``levels`` levels, or (None) up to a single node."""
    widths = [count]
    while len(widths) <= levels if levels is not None else widths[-1] > 1:
        widths.append(-(-widths[-1] // arity))
    return widths


def _labels(widths: list[int]) -> list[int]:
    """Label of the first node of each level."""
    return [sum(widths[:k]) for k in range(len(widths))]


def sweep_up(leaves: list[bytes], arity: int, levels: int | None) -> list[bytes]:
    """Digests of all nodes in the order of their labels; the last is the root of the block."""
    widths = _widths(len(leaves), arity, levels)
    first = _labels(widths)
    found = list(leaves)
    queue = [(first[1] + i // arity, i, x) for i, x in enumerate(leaves)] if len(widths) > 1 else []
    heapq.heapify(queue)
    for level in range(1, len(widths)):
        for i in range(widths[level]):
            label, children = first[level] + i, []
            while queue and queue[0][0] == label:
                children.append(heapq.heappop(queue)[2])
            found.append(digest(b"".join(children)))
            if level + 1 < len(widths):
                heapq.heappush(queue, (first[level + 1] + i // arity, label, found[-1]))
    return found


def sweep_down(nodes: list[bytes], count: int, arity: int, levels: int | None, above: tuple) -> list[tuple]:
    """For each leaf its steps to the root, nearest first, as a chain (step, steps after it); ``above`` is the block's own."""
    widths = _widths(count, arity, levels)
    first = _labels(widths)
    queue = [(-len(nodes) + 1, above)]
    found: list[tuple] = [()] * count
    for level in reversed(range(len(widths))):
        for i in reversed(range(widths[level])):
            _, suffix = heapq.heappop(queue)
            if not level:
                found[i] = suffix
                continue
            start = first[level - 1] + i * arity
            run = nodes[start : min(start + arity, first[level])]
            for j in range(len(run)):
                step = (b"".join(run[:j]), b"".join(run[j + 1 :]))
                heapq.heappush(queue, (-(start + j), (step, suffix)))
    return found


def _steps(chain: tuple) -> Iterator[Step]:
    while chain:
        step, chain = chain
        yield step


def _packed(chain: tuple) -> bytes:
    return b";".join(a + b"," + b for a, b in _steps(chain))


def _unpacked(data: bytes) -> tuple:
    chain: tuple = ()
    for part in reversed(data.split(b";") if data else []):
        a, b = part.split(b",")
        chain = ((a, b), chain)
    return chain


def folded(leaf: bytes, steps: list[Step]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for left, right in steps:
        leaf = digest(left + leaf + right)
    return leaf


def _blocks(stream: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one block after the other; they come sorted by tree and block."""
    held: list[dict] = []
    for batch in stream:
        for row in batch.to_pylist():
            if held and (held[0]["tree"], held[0]["block"]) != (row["tree"], row["block"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, BATCH_ROWS)):
        yield pa.RecordBatch.from_pylist(part, schema=schema)


def _levels(size: int, shape: Shape) -> int | None:
    """A block of a tree of many blocks takes all its levels, an only block as many as lead to one node."""
    return shape.height if size > shape.block else None


def _by_block(nodes: DataFrame, shape: Shape) -> DataFrame:
    """Nodes with their block, the rows of a block together and in order of position."""
    marked = nodes.withColumn("block", F.expr(f"pos div {shape.block}"))
    return marked.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _raised(nodes: DataFrame, shape: Shape) -> DataFrame:
    """(tree, size, pos, digest) of nodes to those of their blocks' roots."""

    def rows(stream):
        for block in _blocks(stream):
            root = sweep_up([r["digest"] for r in block], shape.arity, _levels(block[0]["size"], shape))[-1]
            yield {"tree": block[0]["tree"], "size": -(-block[0]["size"] // shape.block), "pos": block[0]["block"], "digest": root}

    def run(stream):
        return _batched(rows(stream), NODES)

    return _by_block(nodes, shape).mapInArrow(run, "tree string, size long, pos long, digest binary")


def _with_above(nodes: DataFrame, above: DataFrame, shape: Shape) -> DataFrame:
    """Nodes by block, after what their block is sent from above (a row without digest): (tree, block, place of the row)."""
    sent = above.select("tree", F.col("pos").alias("block"), "steps", *[c for c in above.columns if c not in ("tree", "pos", "steps", "size", "digest")])
    own = nodes.withColumn("block", F.expr(f"pos div {shape.block}"))
    return (
        own.unionByName(sent, allowMissingColumns=True)
        .repartition("tree", "block")
        .sortWithinPartitions("tree", "block", F.asc_nulls_first("pos"))
    )


def _lowered(nodes: DataFrame, above: DataFrame, shape: Shape) -> DataFrame:
    """Each node with the steps from it to the root; ``above`` has those of its block (and the roots)."""

    def rows(stream):
        for sent, *block in _blocks(stream):
            for node, chain in zip(block, _chains(sent, block, shape), strict=True):
                yield {x: node[x] for x in ("tree", "pos")} | {x: sent[x] for x in ("subroot", "root")} | {"steps": _packed(chain)}

    def run(stream):
        return _batched(rows(stream), STEPS)

    return _with_above(nodes, above, shape).mapInArrow(run, "tree string, pos long, steps binary, subroot binary, root binary")


def _chains(sent: dict, rows: list[dict], shape: Shape) -> list[tuple]:
    levels = _levels(rows[0]["size"], shape)
    nodes = sweep_up([r["digest"] for r in rows], shape.arity, levels)
    return sweep_down(nodes, len(rows), shape.arity, levels, _unpacked(sent["steps"]))


def _proved(leaves: DataFrame, above: DataFrame, shape: Shape) -> DataFrame:
    """Leaves with proof, roots and what their given (maybe changed) leaf folds to."""
    kind = dict(leaves.dtypes)["id"]
    schema = pa.schema(
        [("id", pa.int64() if kind == "bigint" else pa.string()), ("source", pa.string())]
        + [(x, pa.string()) for x in ("leaf", "subroot", "root", "proof", "folded_root")]
    )

    def rows(stream):
        for sent, *block in _blocks(stream):
            for row, chain in zip(block, _chains(sent, block, shape), strict=True):
                steps = list(_steps(chain))
                yield {
                    "id": row["id"],
                    "source": row["source"],
                    "leaf": row["digest"].decode(),
                    "subroot": sent["subroot"].decode(),
                    "root": sent["root"].decode(),
                    "proof": b"".join(a + b for a, b in steps).decode(),
                    "folded_root": folded(row["changed"], steps).decode(),
                }

    def run(stream):
        return _batched(rows(stream), schema)

    return _with_above(leaves, above, shape).mapInArrow(
        run, f"id {kind}, source string, leaf string, subroot string, root string, proof string, folded_root string"
    )


def numbered(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``pos`` (from 0, within the keys, in ``order``) and ``size`` of the key; one shuffle of the rows.

    Rows are range-partitioned and sorted; the row's number in its partition
    comes with it.  A key's first number in a partition and the rows it has in
    earlier ones are few figures, one for each key and partition, joined back.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.asc_nulls_first(k) for k in keys] + order
    # The id is partition and row in it, taken after the sort.
    at = F.monotonically_increasing_id()
    placed = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_id", at)
    placed = cut(placed.withColumn("_part", F.shiftright("_id", 33)), "numbered")
    sizes = placed.groupBy(*keys, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.col("_part").alias("_of"),
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(whole).alias("size"),
    )
    same = F.col("_part") == F.col("_of")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return placed.join(starts, same).withColumn("pos", F.col("_id") + F.col("_shift")).select(*df.columns, "pos", "size")


def _field(value: Column) -> Column:
    text = value.cast("string")
    size = F.octet_length(text).cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(size, F.lit(":"), text))


def leaf_of(*values: str | Column) -> Column:
    """Digest of a row: each value as ``-`` (null) or UTF-8 byte count, colon, value."""
    return F.sha2(F.concat(*[_field(F.col(v) if isinstance(v, str) else v) for v in values]).cast("binary"), 256)


def _height(most: int, shape: Shape) -> int:
    """Rounds until a tree of ``most`` nodes is one node."""
    rounds = 0
    while most > 1:
        most, rounds = -(-most // shape.block), rounds + 1
    return rounds


def _risen(nodes: DataFrame, shape: Shape, label: str) -> list[DataFrame]:
    """Nodes of every round, from those given to the roots."""
    most = nodes.agg(F.max("size")).first()[0] or 0
    rounds = [nodes]
    for k in range(_height(most, shape)):
        rounds.append(cut(_raised(rounds[-1].select("tree", "size", "pos", "digest"), shape), f"{label}{k}"))
    return rounds


def manifest(rows: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """(id, source, leaf, subroot, root, proof, folded_root) of every row of a manifest.

    ``rows`` has id (long or string), source, leaf (hexadecimal digest) and
    changed: the leaf of the row as it is found now, folded with the siblings of
    the manifest, so that folded_root is root just where the row is the same.
    Leaves of a source stand by id (null first), equal ids by leaf; sources by
    their bytes, null first.  Runs of ``arity`` nodes become one node, a last run
    with fewer, even one, as well; a tree of one node is that node.  ``proof`` is
    the siblings from leaf to root, empty if there are none.  Repeated rows are
    leaves of their own.  An empty table gives no rows.
    """
    prepared(rows.sparkSession)
    # Null is a source of its own: a tree's name says so by its first sign.
    tree = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))
    taken = rows.select(
        "id", "source", tree.alias("tree"), F.col("leaf").cast("binary").alias("digest"), F.col("changed").cast("binary").alias("changed")
    )
    leaves = cut(numbered(taken, ["tree"], [F.asc_nulls_first("id"), F.asc("digest")]), "leaves")
    trees = _risen(leaves, shape, "tree")
    roots = trees[-1].select(F.lit("").alias("all"), F.col("tree").alias("source_tree"), "digest")
    roots = numbered(roots, ["all"], [F.asc("source_tree")]).withColumnRenamed("all", "tree")
    roots = cut(roots, "subroots")
    top = _risen(roots, shape, "top")
    # Back down: the root has no steps, then blocks of the upper tree, its leaves, blocks of the trees, rows.
    down = top[-1].select("tree", "pos", F.lit(b"").alias("steps"), F.lit(b"").alias("subroot"), F.col("digest").alias("root"))
    for k, nodes in enumerate(reversed(top[:-1])):
        down = cut(_lowered(nodes.select("tree", "size", "pos", "digest"), down, shape), f"down{k}")
    found = down.select(F.col("pos").alias("at"), "steps", "root")
    down = roots.join(found, F.col("pos") == F.col("at")).select(
        F.col("source_tree").alias("tree"), F.lit(0).cast("long").alias("pos"), "steps", F.col("digest").alias("subroot"), "root"
    )
    for k, nodes in enumerate(reversed(trees[1:-1])):
        down = cut(_lowered(nodes.select("tree", "size", "pos", "digest"), down, shape), f"rows{k}")
    return _proved(leaves, down, shape)

