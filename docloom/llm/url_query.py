"""Query of the URL rules, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import url_filter
from docloom.llm.queries import query
from docloom.llm.tables import read

#: The rules that are asked for.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

SQL = f"""
with rules(r_host, r_path, r_verdict) as (values {", ".join(str(r) for r in RULES)}),
parts as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
  from pages),
urls as (
  select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path
  from parts),
fits as (
  select page_id, host, path, r_host || r_path as rule, r_verdict,
    row_number() over (partition by page_id order by length(r_host || r_path) desc, length(r_host) desc) as place
  from urls join rules on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path))
select u.page_id, u.host, u.path, f.rule, coalesce(f.r_verdict, 'allow') as verdict
from urls u left join (select * from fits where place = 1) f using (page_id)
"""


@query("op2_url_filters", SQL)
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return url_filter.judge(read(spark, sf_dir, "pages"), rules)
