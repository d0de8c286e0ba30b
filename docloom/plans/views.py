"""Input views over the given tables, as SQL that runs unchanged in Spark and in DuckDB.

``{orders}`` and the like stand for the tables. Each view covers its whole tables. Modulo
arithmetic only varies what a row holds; it never leaves rows out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from docloom.operators.layout import spread

TABLES = ("customer", "orders", "lineitem", "events", "documents", "pages", "conversations")

# File name of an order's document, and its untidy invoice-like text.
_FILENAME = """concat('order-', cast(o.o_orderkey as string), case o.o_orderkey % 5 when 0 then '.pdf'
      when 1 then '.XLSX' when 2 then '.docx' when 3 then '.png' else '.txt' end)"""
_FORM = """concat('# Order', chr(9), 'Form', chr(13), chr(10), '======', chr(10), chr(10), chr(10), chr(10),
    '**  Order Key: ', cast(o.o_orderkey as string), chr(10),
    '- Customer:', chr(9), c.c_name, chr(7), chr(10),
    'Order Date : ', cast(cast(o.o_orderdate as date) as string), chr(10), '|---|---|', chr(10),
    '> Total Price:', cast(cast(o.o_totalprice as decimal(18,2)) as string), chr(10),
    'No: x', chr(10),
    case when o.o_orderkey % 7 = 0 then concat('Customer: duplicate', chr(10)) else '' end,
    case when o.o_orderkey % 5 = 0 then '' else concat('Priority: ', o.o_orderpriority, chr(10)) end,
    '   ', chr(10))"""

VIEWS = {
    "forms": f"""
select o.o_orderkey as doc_id, {_FORM} as text
from {{orders}} o join {{customer}} c on o.o_custkey = c.c_custkey""",
    # All texts: forms, documents, raw pages and conversation turns.
    "texts": """
select 'form' as kind, doc_id, text from forms
union all select 'document' as kind, doc_id, text from {documents}
union all select 'page' as kind, page_id as doc_id, html as text from {pages}
union all select concat('turn ', cast(turn as string)) as kind, conv_id as doc_id, text
  from {conversations}""",
    # The job table.
    "jobs": """
select job_id, filename, concat('uploads/', cast(job_id as string), '/', filename) as file_key,
  file_size, status,
  case when status = 'processing' then 'OCR' end as current_step,
  case when status = 'completed' then concat('doc-', cast(job_id as string)) end as result,
  case when status = 'failed' then concat('ValueError: order ', cast(job_id as string)) end as error,
  case when status = 'completed' then cast(round(price) as int) end as elapsed_ms,
  created_at, created_at as updated_at,
  case when status = 'completed' then created_at end as completed_at
from (
  select o_orderkey as job_id, o_totalprice as price, o_orderdate as created_at,
    {filename} as filename,
    cast(round(o_totalprice * 100) as bigint) as file_size,
    case when o_orderstatus = 'O' then 'queued' when o_orderstatus = 'P' then 'processing'
      when o_orderkey % 10 = 3 then 'failed' else 'completed' end as status
  from {orders} o) j""".replace("{filename}", _FILENAME),
    # Upload attempts: names of many shapes, sizes on both sides of the limit.
    "uploads": """
select o_orderkey as job_id,
  case o_orderkey % 11 when 0 then cast(null as string) when 1 then 'README' when 2 then '.hidden'
    when 3 then 'scan.' when 4 then 'Archive.tar.gz' when 5 then 'a.b/plain' when 6 then 'PHOTO.JPeG'
    else concat('order-', cast(o_orderkey as string), case o_orderkey % 5 when 0 then '.pdf'
      when 1 then '.XLSX' when 2 then '.docx' when 3 then '.tif' else '.txt' end) end as filename,
  case when o_orderkey % 13 = 0 then cast(20971520 as bigint)
    when o_orderkey % 13 = 1 then cast(20971521 as bigint)
    else cast(round(o_totalprice * 100) as bigint) end as file_size
from {orders}""",
    # Stored objects: one per order that has line items, with a size.
    "objects": """
select j.file_key, l.n_lines as length
from jobs j join (select l_orderkey, count(*) as n_lines from {lineitem} group by l_orderkey) l
  on j.job_id = l.l_orderkey""",
    # Ids asked for; some of them belong to no job.
    "requested": "select distinct l_orderkey + l_suppkey as job_id from {lineitem}",
    # Job event log.
    "status_events": """
select event_id, event_id as seq,
  concat(cast(user_id as string), '-', cast(cast(ts as date) as string)) as job_id, ts,
  case event_type when 'signup' then 'queued' when 'purchase' then 'completed'
    when 'error' then 'failed' else 'processing' end as status,
  case event_type when 'view' then 'OCR' when 'click' then 'Qwen' end as step,
  case when event_type = 'view' then case when event_id % 2 = 0 then 'running' else 'ok' end
    when event_type = 'click' then case when event_id % 2 = 0 then 'fallback' else 'ok' end
    end as step_status,
  case when event_type = 'view' then concat(props, ' read') end as detail,
  case when event_type = 'purchase' then cast(round(value * 1000) as int) end as elapsed_ms,
  case when event_type = 'error' and event_id % 2 = 0 then props end as error
from {events}""",
    # The same events as JSON messages, some of them damaged in different ways.
    "event_messages": """
select event_id, case event_id % 13
    when 0 then substring(body, 1, length(body) - 1) when 1 then concat(body, ' tail')
    when 2 then concat(body, '}}') when 3 then concat('[', body, ']') when 4 then ''
    when 5 then concat(' ', body, ' ') when 6 then concat('{{"job_id": "a"}},"message":', body)
    when 7 then concat(body, ',"z":{{}}') else body end as value
from (select event_id, concat('{{"job_id": "', job_id, '", "status": "', status, '"',
    case when step is null then '' else concat(', "step": "', step, '"') end,
    case when elapsed_ms is null then '' else concat(', "elapsed_ms": ', cast(elapsed_ms as string)) end,
    ', "error": null, "extra": {{"a": [1, 2]}}}}') as body
  from status_events) b""",
    # Job rows as first registered, one per job of the event log.
    "event_jobs": """
select job_id, concat(job_id, '.pdf') as filename, concat('uploads/', job_id, '/', job_id, '.pdf') as file_key,
  count(*) as file_size, 'queued' as status, cast(null as string) as current_step,
  cast(null as string) as error, cast(null as int) as elapsed_ms, min(ts) as created_at,
  min(ts) as updated_at, max(case when ts is null then ts end) as completed_at
from status_events group by job_id""",
    # Table rows, one table per order.
    "line_rows": """
select l_orderkey as doc_id, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate,
  cast(l_partkey as string) as c0, cast(cast(l_quantity as int) as string) as c1, l_returnflag as c2
from {lineitem}""",
    # Model responses.
    "llm": """
select event_id as doc_id, case event_id % 5
  when 0 then concat('Here is the JSON: ', props, ' Done.')
  when 1 then props
  when 2 then 'no json here'
  when 3 then '{{"k": '
  else concat('{{"k": "", "n": null, "l": [], "o": {{}}, "z": 0, "f": false, "s": "{{}}", "a": [null], "v": ',
    cast(event_id as string), '}}') end as response
from {events}""",
    # Confidence per order; null without line items. Aggregated before the join.
    "conf": """
select o.o_orderkey as doc_id, l.confidence
from {orders} o left join (select l_orderkey, min(1.0 - l_tax) as confidence
  from {lineitem} group by l_orderkey) l on l.l_orderkey = o.o_orderkey""",
    # The same as text, unreadable for some orders.
    "conf_text": """
select doc_id, case when doc_id % 17 = 0 then 'n/a' when doc_id % 19 = 0 then 'nan'
  when doc_id % 23 = 0 then '0.9f' when doc_id % 29 = 0 then 'inf' when doc_id % 31 = 0 then '0.9d'
  when doc_id % 37 = 0 then ' 0.97 ' else cast(confidence as string) end as confidence
from conf""",
    # What conversion gives for each form. Joins come first and carry narrow rows only.
    "converted": f"""
select o.o_orderkey as doc_id, o.o_orderkey as job_id, {_FILENAME} as filename,
  concat('uploads/', cast(o.o_orderkey as string), '/', {_FILENAME}) as file_key,
  {_FORM} as text, l.confidence, o.o_orderdate as created_at
from {{orders}} o join {{customer}} c on o.o_custkey = c.c_custkey
left join (select l_orderkey, min(1.0 - l_tax) as confidence from {{lineitem}} group by l_orderkey) l
  on l.l_orderkey = o.o_orderkey""",
}


def _needs(text: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", text)]


def _chain(name: str, seen: list[str]) -> None:
    for other in _needs(VIEWS[name]):
        if other != name and other not in seen:
            _chain(other, seen)
    if name not in seen:
        seen.append(name)


def with_views(query: str) -> str:
    """``query`` with the views it names as common table expressions; tables stay ``{...}``.

    Braces in ``query`` itself are taken as they stand.
    """
    chain: list[str] = []
    for name in _needs(query):
        _chain(name, chain)
    head = ",\n".join(f"{name} as ({VIEWS[name]})" for name in chain)
    body = query.replace("{", "{{").replace("}", "}}")
    if not head:
        return body
    joiner = ",\n" if body.lstrip().lower().startswith("with ") else "\n"
    rest = body.lstrip()[5:] if joiner == ",\n" else body
    return f"with {head}{joiner}{rest}"


def check_sql(query: str) -> str:
    """SQL for the registered tables of the check."""
    return with_views(query).format(**{t: t for t in TABLES})


#: Unique key of each table whose rows are costly to work on, and the views that do that work.
KEYS = {
    "orders": ("o_orderkey",),
    "events": ("event_id",),
    "documents": ("doc_id",),
    "pages": ("page_id",),
    "conversations": ("conv_id", "turn"),
}
SPREAD = {
    "forms": ("orders",),
    "texts": ("orders", "documents", "pages", "conversations"),
    "converted": ("orders",),
    "llm": ("events",),
    "event_messages": ("events",),
    "documents": ("documents",),
}


#: A session may name a number of tasks over which tables are hashed before views that work hard on
#: each row. Unset, nothing is shuffled for it.
TASKS_SETTING = "spark.docloom.tasks"


def table(spark: SparkSession, sf_dir: str, name: str, for_view: str | None = None) -> DataFrame:
    """A given table; spread over tasks if the session asks for it and ``for_view`` is costly."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tasks = spark.conf.get(TASKS_SETTING, None)
    if tasks is None or name not in SPREAD.get(for_view or "", ()):
        return df
    return spread(df, int(tasks), *KEYS[name])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; tables are passed in, so nothing is registered in the session."""
    sql = with_views(f"select * from {name}")
    used = {t: table(spark, sf_dir, t, name) for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)
