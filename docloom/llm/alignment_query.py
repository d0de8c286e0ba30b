"""Query of tokenizer alignment. SQL has no tokenizer; its check is a brute-force version in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import alignment
from docloom.llm.queries import query
from docloom.llm.tables import read


@query("op12_tokenizer_alignment")
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.link_strengths(docs, alignment.vocabulary_paths(), form="sha256").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        "n_best",
        "count_sum",
        F.col("groups").alias("groups_sha256"),
    )
