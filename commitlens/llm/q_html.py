"""Query of the main texts of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from commitlens.llm.html import main_text
from commitlens.llm.register import query, table


@query("op8_html")
def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
