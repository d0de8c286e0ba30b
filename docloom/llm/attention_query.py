"""Query of quality scores. SQL cannot express it; tests hold it to a plain version and to held-out labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import attention
from docloom.llm.queries import query
from docloom.llm.tables import read

FOLDS, HELD_OUT = 3, 1


def held_out(doc_id: str) -> Column:
    """Whether a row is kept from learning; false for a null id, which no label can name."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


@query("op13_quality_classifier")
def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = attention.fit(docs, read(spark, sf_dir, "labels"), ~held_out("doc_id"))
    return attention.score(docs, model).select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= attention.THRESHOLD).cast("int").alias("predicted"),
    )
