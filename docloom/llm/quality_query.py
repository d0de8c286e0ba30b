"""Query of the quality rules, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import quality
from docloom.llm.queries import query
from docloom.llm.tables import read

_BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"

SQL = f"""
with w as (
  select doc_id, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: length(translate(l, {_BLANKS}, '')) > 0) as ls
  from documents),
grams as (
  select doc_id, i, list_slice(ws, i, i + 4) as g
  from (select doc_id, ws, unnest(generate_series(1, len(ws) - 4)) as i from w where len(ws) >= 5)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from grams) where n > 1),
spans as (select doc_id, least(5, lead(i, 1, i + 5) over (partition by doc_id order by i) - i) as n from twice),
repeats as (select doc_id, cast(sum(n) as bigint) as n from spans group by doc_id),
counts as (
  select w.doc_id, cast(len(ws) as bigint) as n_words,
    cast(length(translate(text, {_BLANKS}, '')) as bigint) as word_chars,
    cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols,
    cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
    coalesce(r.n, 0) as n_repeat_words,
    len(ls) as n_lines,
    len(list_filter(generate_series(2, len(ws)), lambda i: ws[i] = ws[i - 1])) as n_stutters,
    length(regexp_replace(text, '[^A-Z]+', '', 'g')) as n_capitals
  from w left join repeats r using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or n_symbols * 10 > n_words * 3
    or n_dup_lines * 2 > n_lines or n_stutters * 5 > n_words or n_capitals * 2 > word_chars) as kept
from counts
"""


@query("op5_quality_rules", SQL)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    sample = quality.base_counts(quality.sample_of(docs))
    ordered = quality.order_rules(quality.estimate_rules(sample))
    chosen = quality.cascade(quality.base_counts(docs), ordered)
    base = [r.rejects for r in quality.RULES if r.name in quality.BASE]
    return chosen.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (base[0] | base[1]).alias("base_failed"),
        F.col("rejected_by").isNull().alias("kept"),
    )
