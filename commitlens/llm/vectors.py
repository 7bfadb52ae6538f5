"""Nearest neighbours by inner product: inverted lists scanned with adaptive numbers of dimensions.

Vectors get one component more, so that all have the length of the longest; the
largest inner product is then the smallest distance.  A random rotation spreads
a distance evenly over the components.  Lists are scanned in column blocks: a
candidate whose partial distance, scaled up, lies beyond the current k-th best by
more than a hypothesis test allows is dropped and its other columns are not read.

Equal vectors are one candidate with their smallest ids, however many there are.
Lists and the queries of a list are cut into blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlens.llm.common import cut, prepared


@dataclass(frozen=True)
class Index:
    """Parameters.  ``sample`` bounds the vectors the centroids are fitted on; all are indexed.

    ``strict`` is the slack of the hypothesis test (larger drops less), ``chunk``
    and ``queries`` bound the rows and queries that meet in one call.
    """

    lists: int = 64
    probes: int = 40
    sample: int = 16384
    rounds: int = 8
    columns: int = 16
    strict: float = 2.1
    chunk: int = 8192
    queries: int = 2048
    seed: int = 7


def rotation(size: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with a last component that makes their length ``longest``."""
    x = vectors.astype(np.float64)
    rest = np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))
    return np.column_stack([x, rest])


def asked(vectors: np.ndarray) -> np.ndarray:
    return np.column_stack([vectors.astype(np.float64), np.zeros(len(vectors))])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1)[None, :]


def centroids(points: np.ndarray, index: Index) -> np.ndarray:
    """Lloyd's algorithm on a bounded sample; centres without points stay where they are."""
    rng = np.random.default_rng(index.seed)
    unique = np.unique(points, axis=0)
    centres = unique[rng.permutation(len(unique))[: index.lists]]
    for _ in range(index.rounds):
        near = distances(points, centres).argmin(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        count = np.bincount(near, minlength=len(centres))
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def scan(query: np.ndarray, rows: np.ndarray, k: int, columns: int, strict: float, step: int = 1024) -> np.ndarray:
    """Places of the ``k`` nearest of ``rows`` (rotated), as far as the tests keep them."""
    size, first = rows.shape[1], max(k, 64)
    best, place = np.zeros(0), np.zeros(0, np.int64)
    for at in [0, *range(first, len(rows), step)]:
        part = np.arange(at, min(len(rows), at + step if at else first))
        best, place = _scan_part(query, rows, part, best, place, k, columns, strict, size)
    return place


def _scan_part(query, rows, part, best, place, k, columns, strict, size):
    """The best ``k`` of those known and of ``part``."""
    bound = best[-1] if len(best) == k else np.inf
    partial = np.zeros(len(part))
    for low in range(0, size, columns):
        high = min(size, low + columns)
        gap = rows[part, low:high] - query[low:high]
        partial = partial + np.einsum("ij,ij->i", gap, gap)
        if high < size and np.isfinite(bound):
            # Given up if the partial distance, scaled to all columns, is significantly beyond the bound.
            keep = partial * (size / high) <= bound * (1 + strict / np.sqrt(high)) ** 2
            part, partial = part[keep], partial[keep]
            if not len(part):
                return best, place
    best, place = np.concatenate([best, partial]), np.concatenate([place, part])
    order = np.argsort(best, kind="stable")[:k]
    return best[order], place[order]


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, size)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of vectors without null or non-finite components that are not zero."""
    v = F.col("vec")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    found = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    return found.filter(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(sound, F.lit(False)) & F.exists(v, lambda x: x != 0))


def nearest(
    vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, index: Index | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each query, ties to smaller ids.

    ``is_query`` makes a condition of the id column.  Vectors that are null or
    zero or hold a null or non-finite component take no part, nor do rows
    without an id or (should lengths differ) of another length than the most
    common.  Rows that repeat id and vector count once.  An empty table gives none.
    """
    index, spark = index or Index(), prepared(vectors.sparkSession)
    found = usable(vectors, id_col, vec_col)
    facts = found.groupBy(F.size("vec").alias("size")).agg(
        F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("square")
    )
    common = facts.orderBy(F.desc("n"), "size").first()
    if common is None:
        schema = "query_id long, rank int, vec_id long, score double"
        return spark.createDataFrame([], schema)
    size, longest = common["size"], float(np.sqrt(common["square"]))
    found = found.filter(F.size("vec") == size).distinct()

    # Equal vectors once, with as many of their ids as a result can need.
    first = Window.partitionBy("vec").orderBy("id")
    unique = found.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1)
    unique = unique.groupBy("vec").agg(F.min("id").alias("uid"), F.sort_array(F.collect_list("id")).alias("ids"))
    unique = cut(unique, "vectors")
    queries = found.filter(is_query(F.col("id"))).select(F.col("id").alias("query_id"), F.col("vec").alias("v"))
    queries = cut(queries.join(unique, queries["v"] == unique["vec"]).select("query_id", "uid", "vec"), "queries")

    turn = rotation(size + 1, index.seed)
    sample = unique.orderBy(F.xxhash64("uid"), "uid").limit(index.sample).select("vec").toArrow()
    centres = centroids(lifted(_matrix(sample["vec"], size), longest), index)

    def nearest_lists(column: str, count: int, lift) -> object:
        """Adds the nearest lists of the vector."""

        def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                x = lift(_matrix(batch.column(batch.schema.get_field_index(column)), size))
                order = np.argsort(distances(x, centres), axis=1, kind="stable")[:, :count].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(list(order), pa.list_(pa.int32()))], names=[*batch.schema.names, "lists"]
                )

        return batches

    def routed(df: DataFrame, count: int, lift) -> DataFrame:
        schema = T.StructType([*df.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))])
        return df.mapInArrow(nearest_lists("vec", count, lift), schema).withColumn("list", F.explode("lists")).drop("lists")

    rows = cut(routed(unique.select("uid", "vec"), 1, lambda v: lifted(v, longest)), "listed")
    probes = cut(routed(queries.select("uid", "vec").dropDuplicates(["uid"]), index.probes, asked), "probes")
    # One number per list, as many as the parameter says.
    parts = lambda df, most: {r["list"]: -(-r["n"] // most) for r in df.groupBy("list").agg(F.count("*").alias("n")).collect()}
    chunks, blocks = parts(rows, index.chunk), parts(probes, index.queries)
    number = lambda by: F.array(*(F.lit(by.get(i, 0)) for i in range(len(centres))))[F.col("list")]
    several = lambda by: F.explode(F.when(number(by) > 0, F.sequence(F.lit(0), number(by) - 1)).otherwise(F.array().cast("array<int>")))
    own = lambda by: F.pmod(F.xxhash64("uid"), F.greatest(number(by), F.lit(1))).cast("int")
    rows = rows.withColumn("chunk", own(chunks)).withColumn("block", several(blocks))
    probes = probes.withColumn("block", own(blocks)).withColumn("chunk", several(chunks))

    def scan_group(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"q": [], "c": [], "score": []}
        if left.num_rows and right.num_rows:
            x, y = _matrix(left["vec"], size), _matrix(right["vec"], size)
            ids = left["uid"].to_numpy()
            turned, asking = lifted(x, longest) @ turn, asked(y) @ turn
            for i, q in enumerate(right["uid"].to_pylist()):
                place = scan(asking[i], turned, k + 1, index.columns, index.strict)
                out["q"].append(np.full(len(place), q))
                out["c"].append(ids[place])
                out["score"].append(np.einsum("ij,j->i", x[place], y[i]))
        none = [np.zeros(0)]
        return pa.table(
            {
                "q": pa.array(np.concatenate(out["q"] or none).astype(np.int64)),
                "c": pa.array(np.concatenate(out["c"] or none).astype(np.int64)),
                "score": pa.array(np.concatenate(out["score"] or none).astype(np.float64)),
            }
        )

    key = ["list", "chunk", "block"]
    met = rows.groupBy(*key).cogroup(probes.groupBy(*key)).applyInArrow(scan_group, "q long, c long, score double")
    best = lambda by, tie: Window.partitionBy(by).orderBy(F.desc("score"), tie)
    top = met.withColumn("nth", F.row_number().over(best("q", "c"))).filter(F.col("nth") <= k + 1).drop("nth")
    top = top.join(unique.select(F.col("uid").alias("c"), "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
    top = cut(top.withColumn("nth", F.row_number().over(best("q", "vec_id"))).filter(F.col("nth") <= k + 1).drop("nth"), "top")
    each = queries.select("query_id", F.col("uid").alias("q")).join(top, "q").filter("vec_id != query_id")
    each = each.withColumn("rank", F.row_number().over(best("query_id", "vec_id"))).filter(F.col("rank") <= k)
    return each.select("query_id", "rank", "vec_id", "score")
