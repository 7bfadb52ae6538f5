"""Query of the repeated passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.llm.register import query, table
from commitlens.llm.substrings import Parsing, repeated_spans, without_spans


@query("op3_substrings")
def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = without_spans(repeated_spans(docs, parsing=Parsing(window=35)), "text", "spans")
    digest = F.sha2(F.col("kept_text").cast("binary"), 256)
    return kept.select("doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))
