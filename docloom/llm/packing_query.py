"""Query of packing. Its check is a brute-force version in the tests: SQL has no tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import packing
from docloom.llm.queries import query
from docloom.llm.tables import read


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.decompose(read(spark, sf_dir, "documents"), packing.tokenizer_path())
    return packing.sequences(pieces).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "bucket",
    )
