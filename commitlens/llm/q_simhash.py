"""Query of SimHash near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.llm.register import query, table
from commitlens.llm.simhash import hex_fingerprint, near_duplicates


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs, shingle=4, distance=4)
    return found.select("doc_id", hex_fingerprint(F.col("fingerprint")).alias("fingerprint"), "component_id")
