"""What several operators share: words, Arrow maps, names, connected groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlens.session import configure, scratch_path

#: White space between words, as a class of regular expressions (Java, RE2, Python).
SPACE = r"[\x20\x09-\x0D]+"

#: Rows of an Arrow batch: bounds what a Python worker holds beside one text.
BATCH_ROWS = 512


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings the operators count on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    # Steps end in written tables, so the shuffles before them can go at once.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """The session with other settings (dots as two underscores) for what is run inside."""
    keys = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder, well compressed, and read it back: ends lineage and gives true sizes."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.written_to = path
    return written


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` has written, once nothing that is still to run reads them."""
    for table in tables:
        spark = table.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of ``df`` has it."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def binary(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def append_columns(
    docs: DataFrame,
    text_col: str,
    fields: list[T.StructField],
    values: Callable[[list[bytes]], list],
) -> DataFrame:
    """``docs`` with columns that ``values`` makes from a batch of texts.

    Rows and their other columns pass through.  ``values`` returns one Arrow
    array (or list) per field.
    """
    at = docs.columns.index(text_col)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            more = [pa.array(x) if not isinstance(x, pa.Array) else x for x in values(binary(batch.column(at)))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *more], names=[*batch.schema.names, *(f.name for f in fields)]
            )

    return docs.mapInArrow(batches, T.StructType([*docs.schema.fields, *fields]))


def word_ids(tokens: list[bytes], known: dict[bytes, int], hashed: Callable[[bytes], int]) -> np.ndarray:
    """64-bit hashes of words through a memo that is emptied when it gets large."""
    if len(known) > 1 << 18:
        known.clear()
    for word in set(tokens).difference(known):
        known[word] = hashed(word)
    return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of edges: equal for equal sets."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first()
    return tuple(row)


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of undirected ``edges`` (a, b); root is the smallest node reached.

    Alternates large and small stars (each node is tied to the smallest
    neighbour), which ends after few rounds even for long chains.  Every round
    is two aggregations and two joins on the edges still held, written to the
    shared folder.  Self edges and repeated edges do no harm; nodes are longs.
    """
    e = edges.filter("a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    e = cut(e.distinct(), "edges")
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.filter("u != v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u != v")
            .union(least.select("u", F.col("m").alias("v")))
        )
        old, e = e, cut(small.distinct(), "small")
        drop(old, large)
        before, state = state, _state(e)
        if before == state:
            break
    found = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
