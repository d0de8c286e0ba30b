"""Queries over texts: cleaning and extraction by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import fields, text
from docloom.operators import extraction
from docloom.operators.layout import explode_rows
from docloom.plans import sql_parts as P
from docloom.plans.registry import query
from docloom.plans.views import view

KEYS = "kind, doc_id"


@query("strip_control", f"select {KEYS}, {P.no_control('text')} as text from texts")
def strip_control(spark, sf_dir):
    texts = view(spark, sf_dir, "texts")
    return texts.withColumn("text", text.strip_control(F.col("text")))


@query("collapse_blanks", f"select {KEYS}, {P.one_blank('text')} as text from texts")
def collapse_blanks(spark, sf_dir):
    texts = view(spark, sf_dir, "texts")
    return texts.withColumn("text", text.collapse_blanks(F.col("text")))


_LINES = f"""with numbered as (select {KEYS}, unnest({P.lines_of('text')}) as line,
  generate_subscripts({P.lines_of('text')}, 1) as line_no from texts)"""


@query("doc_lines", _LINES + " select kind, doc_id, cast(line_no as int) as line_no, line from numbered")
def doc_lines(spark, sf_dir):
    return extraction.trimmed_lines(view(spark, sf_dir, "texts")).drop("is_rule")


@query(
    "rule_lines",
    _LINES
    + f""" select kind, doc_id, cast(line_no as int) as line_no, line,
  regexp_matches(line, {P.RULE}) as is_rule from numbered""",
)
def rule_lines(spark, sf_dir):
    return extraction.trimmed_lines(view(spark, sf_dir, "texts"))


@query(
    "clean_text",
    P.steps(P.cleaned("texts", KEYS), select="select kind, doc_id, cleaned_text from cleaned"),
)
def clean_text(spark, sf_dir):
    return extraction.clean(view(spark, sf_dir, "texts"))


@query(
    "clean_stats",
    P.steps(
        P.cleaned("texts", KEYS),
        select="""select kind, doc_id, cast(length(text) as int) as raw_chars,
  cast(length(cleaned_text) as int) as clean_chars from cleaned""",
    ),
)
def clean_stats(spark, sf_dir):
    return extraction.clean_stats(view(spark, sf_dir, "texts"))


@query(
    "kv_lines",
    P.steps(
        P.cleaned("texts", KEYS),
        P.split_lines(KEYS),
        select="""select kind, doc_id, cast(line_no as int) as line_no, line,
  contains(line, ':') and length(line) <= 300 as is_candidate from lines""",
    ),
)
def kv_lines(spark, sf_dir):
    return extraction.candidate_lines(extraction.clean(view(spark, sf_dir, "texts")))


@query(
    "kv_regex",
    P.steps(P.kv_steps("texts", KEYS), select="select kind, doc_id, field_no, key, val from kv"),
)
def kv_regex(spark, sf_dir):
    return extraction.field_rows(view(spark, sf_dir, "texts"))


def _map_rows(spark, sf_dir):
    """The field map of each text, taken apart again in its order."""
    found = extraction.extract(view(spark, sf_dir, "texts"))
    entries = F.map_entries(fields.fields_map(F.col("fields")))
    rows = explode_rows(found, ["kind", "doc_id"], entries, "row_no", "entry")
    return rows.select("kind", "doc_id", "row_no", "entry.key", F.col("entry.value").alias("val"))


@query(
    "kv_map",
    P.steps(P.kv_steps("texts", KEYS), select="select kind, doc_id, key, val from kv"),
)
def kv_map(spark, sf_dir):
    return _map_rows(spark, sf_dir).drop("row_no")


@query(
    "kv_flat",
    P.steps(
        P.kv_steps("texts", KEYS),
        select="select kind, doc_id, field_no as row_no, key as field, val as value from kv",
    ),
)
def kv_flat(spark, sf_dir):
    rows = _map_rows(spark, sf_dir)
    return rows.withColumnsRenamed({"key": "field", "val": "value"})


@query(
    "kv_found",
    P.steps(
        P.kv_steps("texts", KEYS),
        select="""select t.kind, t.doc_id, cast(count(kv.key) as int) as kv_found
  from texts t left join kv on kv.kind = t.kind and kv.doc_id = t.doc_id group by t.kind, t.doc_id""",
    ),
)
def kv_found(spark, sf_dir):
    found = extraction.extract(view(spark, sf_dir, "texts"))
    return found.select("kind", "doc_id", F.size("fields").alias("kv_found"))
