"""Query of the nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from commitlens.llm.register import query, table
from commitlens.llm.vectors import nearest


@query("op7_vectors")
def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)
