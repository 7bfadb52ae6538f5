"""Query of SentencePiece encoding and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.llm.pieces import decoded, encoded
from commitlens.llm.register import query, table

#: Where the public model file lies on every machine.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def tokens(docs: DataFrame, model_path: str = MODEL, n: int = 4) -> DataFrame:
    """Pieces, n best paths and the round trip of every text."""
    found = decoded(encoded(docs.select("doc_id", "text"), model_path, n=n), model_path)
    return found.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"),
        "ids",
        "paths",
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


@query("op9_sentencepiece")
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(table(spark, sf_dir, "documents"))
