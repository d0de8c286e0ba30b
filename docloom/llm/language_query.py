"""Query of language identification. SQL cannot express it; tests hold it to held-out accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import language
from docloom.llm.queries import query
from docloom.llm.tables import held_out, learnable, read


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs, learnable("doc_id"))
    found = language.identify(docs, model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
