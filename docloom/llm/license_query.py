"""Query of license scans, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import licenses
from docloom.llm.queries import query
from docloom.llm.tables import read

_TEMPLATES = ", ".join(
    f"({i}, '{t.label}', {str(t.exact).lower()}, string_split('{t.words}', ' '))"
    for i, t in enumerate(licenses.PHRASES + licenses.NOTICES)
)

SQL = f"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws
  from documents),
t(template, label, exact, tw) as (values {_TEMPLATES}),
tp as (
  select template, label, exact, len(tw) - 1 as size, i as pos, tw[i] as a, tw[i + 1] as b
  from (select *, unnest(generate_series(1, len(tw) - 1)) as i from t)),
dp as (
  select doc_id, i as place, ws[i] as a, ws[i + 1] as b
  from (select doc_id, ws, unnest(generate_series(1, len(ws) - 1)) as i from d where len(ws) > 1)),
votes as (
  select doc_id, template, label, exact, size, place - pos as diagonal, pos
  from dp join tp using (a, b)),
diagonals as (
  select doc_id, template, label, exact, size, diagonal, count(*) = any_value(size) as whole
  from votes group by all),
spans as (
  select *, sum(new) over (partition by doc_id, template order by diagonal rows unbounded preceding) as span
  from (select *, case when diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal) <= {licenses.GAP}
      then 0 else 1 end as new from diagonals)),
covers as (
  select s.doc_id, s.template, s.label, s.exact, s.span, count(distinct v.pos) * 1.0 / any_value(s.size) as cover
  from spans s join votes v on s.doc_id = v.doc_id and s.template = v.template and s.diagonal = v.diagonal
  group by all),
found as (
  select doc_id, label, cover from covers where not exact and cover >= {licenses.MIN_COVER}
  union all select doc_id, label, 1.0 from diagonals where exact and whole),
places as (
  select doc_id, count(*) as n, min(diagonal) as first_word, max(diagonal) as last_word
  from diagonals where exact and whole group by doc_id),
base as (
  select doc_id, string_agg(label, ',' order by label) as labels
  from (select distinct doc_id, label from diagonals where exact and whole) group by doc_id),
named as (
  select doc_id, string_agg(label, ',' order by label) as labels
  from (select distinct doc_id, label from found) group by doc_id),
scores as (select doc_id, max(cover) as score from found group by doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(p.n, 0) as n_base,
  cast(p.first_word as bigint) as first_word, cast(p.last_word as bigint) as last_word,
  coalesce(b.labels, '') as base_labels, coalesce(n.labels, '') as labels,
  cast(coalesce(s.score, 0) as double) as score
from d left join places p using (doc_id) left join base b using (doc_id)
left join named n using (doc_id) left join scores s using (doc_id)
"""


@query("op6_license_scans", SQL)
def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.col("places").alias("n_base"),
        F.col("first").alias("first_word"),
        F.col("last").alias("last_word"),
        F.array_join("exact_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
