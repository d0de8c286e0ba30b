"""Cleaning and field extraction over a table of texts. Every step is narrow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import fields, text
from docloom.operators.layout import explode_rows


def _others(df: DataFrame, *taken: str) -> list[str]:
    return [c for c in df.columns if c not in taken]


def clean(docs: DataFrame, column: str = "text") -> DataFrame:
    """Documents with ``cleaned_text`` in place of ``column``."""
    return docs.select(*_others(docs, column), text.clean_text(F.col(column)).alias("cleaned_text"))


def clean_stats(docs: DataFrame, column: str = "text") -> DataFrame:
    """Characters before and after cleaning."""
    return docs.select(
        *_others(docs, column),
        F.length(column).alias("raw_chars"),
        F.length(text.clean_text(F.col(column))).alias("clean_chars"),
    )


def trimmed_lines(docs: DataFrame, column: str = "text") -> DataFrame:
    """One row per trimmed line, with ``line_no`` from 1 and the rule-line flag."""
    lines = text.doc_lines(F.col(column))
    rows = explode_rows(docs, _others(docs, column), lines, "line_no", "line")
    return rows.withColumn("is_rule", text.is_rule_line(F.col("line")))


def candidate_lines(docs: DataFrame, column: str = "cleaned_text") -> DataFrame:
    """K1-K3: undecorated lines of a cleaned text with their line number and candidate flag."""
    lines = F.transform(fields.text_lines(F.col(column)), fields.undecorated)
    rows = explode_rows(docs, _others(docs, column), lines, "line_no", "line")
    return rows.withColumn("is_candidate", fields.is_candidate(F.col("line")))


def extract(docs: DataFrame, column: str = "text") -> DataFrame:
    """T1-T7 and K1-K6 in one narrow pass: raw texts with ``fields`` in place of ``column``."""
    return docs.select(
        *_others(docs, column),
        fields.extract_fields(text.clean_text(F.col(column))).alias("fields"),
    )


def field_rows(docs: DataFrame, column: str = "text") -> DataFrame:
    """K6 in long form: ``(…, field_no, key, val)``, one row per field of a raw text."""
    found = fields.extract_fields(text.clean_text(F.col(column)))
    rows = explode_rows(docs, _others(docs, column), found, "field_no", "field")
    return rows.select(
        *_others(docs, column), "field_no", F.col("field.key"), F.col("field.value").alias("val")
    )
