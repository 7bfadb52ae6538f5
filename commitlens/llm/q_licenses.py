"""Query of the licence scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.llm.common import words
from commitlens.llm.licenses import licences
from commitlens.llm.register import query, table


def files(docs: DataFrame) -> DataFrame:
    """Documents as files: source, language and hundreds of the id are directories; short texts with a licence are licence files."""
    short = (F.size(words(F.col("text"))) < 50) & F.lower("text").contains("licen")
    name = F.concat(F.when(short, "LICENSE-").otherwise("doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    folder = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100).cast("string"))
    return docs.select("doc_id", F.concat_ws("/", F.when(short, F.concat_ws("/", "source", "lang")).otherwise(folder), name).alias("path"), "text")


@query("op4_licenses")
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(files(table(spark, sf_dir, "documents")))
