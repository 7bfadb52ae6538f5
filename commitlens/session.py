"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession

# Runtime settings every plan in this package counts on.  A hot repository,
# commit, path or class is split by AQE's skew join, which also has to work
# where the join feeds an aggregation on the same key (hence "force").
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def session(name: str = "commitlens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder: on a
    cluster a machine-local path would be lost with its machine.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="commitlens-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Ends the lineage at a table that survives lost executors, is read with
    column pruning and gives later joins a true size.  Zstandard, as most of
    what is written are paths and hashes, which Snappy leaves as they are.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(seen: Observation, *names: str) -> dict[str, int]:
    """Counts an action has made on its way; zeros where there was nothing to run over, as Spark then reports none."""
    try:
        found = seen.get
    except Py4JJavaError:
        found = {}
    return {name: found.get(name) or 0 for name in names}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder, under the name of this application."""
    owner = f"commitlens-{spark.sparkContext.applicationId}"
    return f"{shared_folder(spark).rstrip('/')}/{owner}/{label}-{uuid.uuid4().hex}"
