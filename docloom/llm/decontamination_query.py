"""Query of benchmark decontamination, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontamination
from docloom.llm.queries import query
from docloom.llm.tables import read

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    rf"'abcdefghijklmnopqrstuvwxyz'), '{decontamination.WORD}')"
)

SQL = f"""
with d as (select doc_id, {_WORDS} as ws from documents),
b as (select item_id, {_WORDS} as ws from benchmark),
lengths as (select distinct least(len(ws), 10) as n from b where len(ws) > 0),
windows as (
  select distinct item_id, n, list_slice(ws, i, i + n - 1) as w
  from (select item_id, ws, least(len(ws), 10) as n,
      unnest(generate_series(1, len(ws) - least(len(ws), 10) + 1)) as i from b where len(ws) > 0)),
grams as (
  select doc_id, n, i, list_slice(ws, i, i + n - 1) as w
  from (select doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) as i from d, lengths where len(ws) >= n)),
hits as (select g.doc_id, g.i, g.n, w.item_id from grams g join windows w on g.n = w.n and g.w = w.w),
covered as (select distinct doc_id, unnest(generate_series(i, i + n - 1)) as word from hits),
counts as (select doc_id, count(*) as n_hit from covered group by doc_id),
named as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join counts using (doc_id) left join named using (doc_id)
"""


@query("op8_benchmark_decontamination", SQL)
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find(docs, read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )
