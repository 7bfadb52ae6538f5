"""Query of the Merkle manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.llm.merkle import leaf_of, manifest
from commitlens.llm.register import query, table


def leaves(docs: DataFrame) -> DataFrame:
    """Rows of the manifest: the leaf, and the leaf of the row without line ends where the checksum of its id is even."""

    def leaf(text):
        return leaf_of("doc_id", "source", "lang", "n_chars", text)

    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(even, leaf(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    original = leaf("text")
    return docs.select(
        F.col("doc_id").alias("id"), "source", original.alias("leaf"), F.coalesce(changed, original).alias("changed")
    )


@query("op13_merkle")
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    return manifest(leaves(docs)).select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
