"""Query of BPE encoding and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.llm.bpe import decoded, encoded
from commitlens.llm.register import query, table

#: Where the public file lies on every machine.
FILE = "/opt/tokenizers/byte_bpe_50k.json"


@query("op12_bpe")
def op12_bpe(spark: SparkSession, sf_dir: str, path: str = FILE) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decoded(encoded(docs, path).drop("text"), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
