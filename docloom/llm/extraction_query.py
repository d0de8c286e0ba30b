"""Query of HTML extraction. SQL cannot express it; tests hold it to a plain reading of the pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import extraction
from docloom.llm.queries import query
from docloom.llm.tables import read


@query("op10_html_extraction")
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extraction.extract(pages).select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars")
    )
