"""Query of the n-gram Jaccard join, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import jaccard
from docloom.llm.queries import query
from docloom.llm.tables import read

SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents),
s as (
  select distinct doc_id, list_slice(ws, i, i + 4) as g
  from (select doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) as i from d where len(ws) > 0)),
sizes as (select doc_id, count(*) as n from s group by doc_id),
common as (
  select x.doc_id as a, y.doc_id as b, count(*) as shared
  from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by all),
links as (
  select o.a, o.b from common o join sizes p on o.a = p.doc_id join sizes q on o.b = q.doc_id
  where 100 * shared >= 80 * (p.n + q.n - shared)),
reach(a, b) as (
  select a, b from links
  union select r.a, l.b from reach r join links l on r.b = l.a),
nearest as (select a, min(b) as b from reach group by a)
select d.doc_id, coalesce(z.n, 0) as n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) as component_id
from d left join sizes z using (doc_id) left join nearest l on l.a = d.doc_id
"""


@query("op7_ngram_jaccard_join", SQL)
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard.join(read(spark, sf_dir, "documents"))
    return jaccard.with_component(joined).select("doc_id", "n_shingles", "component_id")
