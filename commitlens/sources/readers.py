"""Readers: every table has a declared schema, nothing is inferred.

Hashes are text from the start, so an all-digit hash keeps its zeros.
"""

from __future__ import annotations

import csv
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from commitlens.functions.values import parse_utc
from commitlens.operators.funnel import combine
from commitlens.session import cut, observed

CORRUPT = "_corrupt"
MARK = "_published"


def scan_csv(
    spark: SparkSession, paths: str | list[str], schema: str, multi_line: bool = False
) -> DataFrame:
    """CSV whose header holds the columns of ``schema``, in that order.

    ``multi_line`` is for text with line breaks; such a file is not split.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(paths)
    )


def scan_csv_dates(
    spark: SparkSession, paths: str | list[str], schema: str, dates: list[str]
) -> DataFrame:
    """CSV whose ``dates`` columns hold ISO-8601 text; bad dates become null."""
    df = scan_csv(spark, paths, schema)
    return df.withColumns({c: parse_utc(F.col(c).cast("string")) for c in dates})


def scan_csv_checked(
    spark: SparkSession, paths: str | list[str], schema: str
) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of CSV files: rows that fit the schema, and (file, record) of those that don't.

    Too few or too many values, values of another type and broken quotes make
    a record an error.  Quoted values may hold line breaks.  The files are
    parsed once and written down.
    """
    wanted = spark.createDataFrame([], schema).schema
    parsed = (
        spark.read.schema(f"{schema}, {CORRUPT} string")
        .option("header", True)
        .option("enforceSchema", False)
        .option("escape", '"')
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(paths)
        .withColumn("_file", F.input_file_name())
    )
    parsed = cut(parsed, "parsed")
    bad = F.col(CORRUPT).isNotNull()
    rows = parsed.where(~bad).select(*wanted.names)
    return rows, parsed.where(bad).select(F.col("_file").alias("file"), F.col(CORRUPT).alias("record"))


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of a file, without reading the rest."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(hadoop)
    if fs.getFileStatus(place).isDirectory():
        parts = sorted(s.getPath().toString() for s in fs.listStatus(place) if s.getPath().getName().startswith("part-"))
        return first_line(spark, parts[0]) if parts else ""
    stream = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(place), "UTF-8"))
    try:
        return stream.readLine() or ""
    finally:
        stream.close()


def scan_csv_by_name(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """CSV parts whose columns may come in different orders, as one table.

    The first line of each part says its columns.  Parts with the same line
    are read together, so there are as many reads as there are layouts, however
    many parts.  Columns that the schema doesn't name are left out, columns that
    a part lacks are null, as are values of another type.
    """
    wanted = {f.name: f for f in spark.createDataFrame([], schema).schema}
    layouts: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        header = next(csv.reader([first_line(spark, path)]), [])
        layouts.setdefault(tuple(header), []).append(path)
    parts = []
    for header, group in layouts.items():
        as_text = ", ".join(f"`{name.replace('`', '``')}` string" for name in header)
        text = scan_csv(spark, group, as_text, multi_line=True)
        parts.append(text.select(*[F.col(f"`{n}`").try_cast(wanted[n].dataType).alias(n) for n in header if n in wanted]))
    return combine(parts).select(*[n for n in wanted if any(n in p.columns for p in parts)])


def scan_csv_column(
    spark: SparkSession, path: str, schema: str, column: str = "repo", limit: int = 0
) -> DataFrame:
    """One column of a CSV; ``limit`` 0 reads all."""
    values = scan_csv(spark, path, schema).select(column)
    return values.limit(limit) if limit > 0 else values


def scan_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file holding an array of objects, one row per object."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def scan_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet table; filters and columns reach the scan."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def _mark(spark: SparkSession, path: str):
    """File system and place of the mark that names the published copy under ``path``."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{MARK}")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def published(spark: SparkSession, path: str) -> str | None:
    """The folder of the copy that is published under ``path``; None before that."""
    fs, mark = _mark(spark, path)
    return f"{path.rstrip('/')}/{first_line(spark, mark.toString())}" if fs.exists(mark) else None


def publish(spark: SparkSession, path: str, copy: str) -> str:
    """Make ``copy`` (a folder under ``path``) the published one, unless another is; returns that which is.

    The mark is made by a create that fails where it exists, so of several
    writers exactly one publishes.
    """
    fs, mark = _mark(spark, path)
    try:
        stream = fs.create(mark, False)
        stream.write(bytearray(copy, "utf-8"))
        stream.close()
    except Py4JJavaError:
        if not fs.exists(mark):
            raise
    return published(spark, path)


def read_published(spark: SparkSession, path: str, schema: str, seconds: float = 0) -> DataFrame:
    """Rows of the published copy; waits up to ``seconds`` for its mark."""
    until = time.monotonic() + seconds
    while (found := published(spark, path)) is None:
        if time.monotonic() >= until:
            raise FileNotFoundError(f"nothing is published at {path}")
        time.sleep(min(0.2, max(0.0, until - time.monotonic())))
    return spark.read.schema(schema).json(found)


def cache_json(df: DataFrame, path: str, schema: str) -> DataFrame:
    """Rows kept as JSON Lines under ``path``; a published copy is read instead.

    A copy is written beside, its rows are counted on the way and counted again
    in what was written, and only then it is published.  What a broken write
    leaves is never read.
    """
    spark = df.sparkSession
    if published(spark, path) is None:
        copy, seen = f"copy-{uuid.uuid4().hex}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.json(f"{path.rstrip('/')}/{copy}")
        written = spark.read.text(f"{path.rstrip('/')}/{copy}").count()
        rows = observed(seen, "rows")["rows"]
        if written != rows:
            raise RuntimeError(f"{written} of {rows} rows were written to {path}/{copy}")
        publish(spark, path, copy)
    return read_published(spark, path, schema)
