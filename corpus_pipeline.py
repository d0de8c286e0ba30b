"""A training corpus from ``documents``: clean it, then cut it into pieces for packing.

Each stage works on all that the one before it kept, and returns the columns of ``documents`` but for
the last. Stages of the pipeline and of other operators alike give whole results; see each operator for
nulls, ties, repeated rows and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontamination, jaccard, language, packing, toxicity
from docloom.llm.tables import learnable, read, stored

#: A text whose language is less sure than that is taken for none; an even choice of four is 0.25.
MIN_LANGUAGE_SCORE = 0.3


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), learnable("doc_id"))
    scored = toxicity.score(docs, model, column="_toxicity")
    return scored.filter(F.col("_toxicity") < toxicity.THRESHOLD).drop("_toxicity")


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of no known language go; a missing language is filled in."""
    model = language.fit(docs, learnable("doc_id"))
    found = language.predict(docs, model, "text", "_lang", "_score")
    sure = (F.col("_lang") != language.UNKNOWN) & (F.col("_score") >= MIN_LANGUAGE_SCORE)
    return found.filter(sure).withColumn("lang", F.coalesce("lang", "_lang")).drop("_lang", "_score")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays."""
    return jaccard.one_per_component(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items go, and documents that are mostly such."""
    kept = decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, each a sequence."""
    return packing.sequences(packing.decompose(docs, packing.tokenizer_path()))


STAGES = [
    ("toxicity", without_toxic),
    ("language_id", in_a_language),
    ("ngram_jaccard_join", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("packing", packed),
]

#: SQL cannot express a tokenizer or a learned model; tests hold each stage to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage kept is written and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
