"""Queries of the reports over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import model, quality
from docloom.functions.times import epoch_micros
from docloom.operators import extraction, reports
from docloom.plans import sql_parts as P
from docloom.plans.registry import query
from docloom.plans.views import table, view
from docloom.session import shared_dir

CUTOFF_SECONDS = 7 * 24 * 3600
PIVOT = {"Order Key": "order_key", "Customer": "customer", "Total Price": "total_price", "Priority": "priority"}


@query(
    "status_rollup",
    """select status, day, cast(grouping(status, day) as int) as level, count(*) as jobs,
  cast(sum(file_size) as bigint) as bytes, avg(elapsed_ms) as mean_elapsed_ms
from (select *, cast(created_at as date) as day from jobs) j group by cube (status, day)""",
)
def status_rollup(spark, sf_dir):
    return reports.status_rollup(view(spark, sf_dir, "jobs"))


@query(
    "field_coverage",
    P.steps(
        P.kv_steps("texts", "kind, doc_id"),
        select="""select key, count(*) as documents, count(distinct val) as distinct_values,
  count(*) / (select cast(count(*) as double) from texts) as share from kv group by key""",
    ),
)
def field_coverage(spark, sf_dir):
    texts = view(spark, sf_dir, "texts")
    return reports.field_coverage(extraction.field_rows(texts).select("key", "val"), texts.count())


TOP_KEYS = 10


@query(
    "top_keys",
    P.steps(
        P.kv_steps("texts", "kind, doc_id"),
        select=f"select key, count(*) as documents from kv group by key order by documents desc, key limit {TOP_KEYS}",
    ),
)
def top_keys(spark, sf_dir):
    """The keys that most texts have; the field rows are written once, as they are looked at twice."""
    path = shared_dir(spark, "field-keys")
    extraction.field_rows(view(spark, sf_dir, "texts")).select("key").write.parquet(path)
    return reports.top_keys(spark.read.schema("key string").parquet(path), TOP_KEYS)


COVERAGE_BOUND = 0.05


@query(
    "coverage_by_day",
    P.steps(
        P.kv_steps("forms", "doc_id"),
        select="select key, count(*) as documents, true as is_near from kv group by key",
    ),
)
def coverage_by_day(spark, sf_dir):
    """Fields of all forms as states of the day a form was made, written, read back and merged; with whether the
    merged estimate of distinct values is near their true number."""
    forms = view(spark, sf_dir, "forms")
    made = view(spark, sf_dir, "jobs").select(F.col("job_id").alias("doc_id"), F.to_date("created_at").alias("day"))
    rows = extraction.field_rows(forms).join(made, "doc_id").select("day", "key", "val")
    path = shared_dir(spark, "coverage-states")
    reports.daily_coverage(rows).hint("rebalance").write.parquet(path)
    merged = reports.merged_coverage(spark.read.parquet(path))
    exact = reports.field_coverage(rows, 1).select("key", F.col("distinct_values").alias("exact"))
    off = F.abs(F.col("distinct_values") - F.col("exact")) <= COVERAGE_BOUND * F.col("exact")
    return merged.join(exact, "key").select("key", "documents", off.alias("is_near"))


@query(
    "step_stats",
    f"""select step, count(*) as jobs, min(s) as least_s, round(quantile_cont(s, 0.5), 3) as median_s,
  round(quantile_cont(s, 0.9), 3) as p90_s, max(s) as most_s
from (select step, {P.round_binary('s', 2)} as s from (
  select job_id, step, (max(epoch_us(ts)) filter (step_status <> 'running')
    - min(epoch_us(ts)) filter (step_status = 'running')) / 1000000 as s
  from status_events where step_status is not null group by job_id, step) t where s is not null) u group by step""",
)
def step_stats(spark, sf_dir):
    return reports.step_stats(view(spark, sf_dir, "status_events"))


STUCK_SQL = f"""with newest as (select max(epoch_us(ts)) as now from status_events)
select job_id, arg_max(status, seq) as status, (any_value(now) - max(epoch_us(ts))) // 1000000 as idle_s
from status_events, newest group by job_id
having count(*) filter (status in ('completed', 'failed')) = 0
  and any_value(now) - max(epoch_us(ts)) >= {CUTOFF_SECONDS * 1_000_000}"""


@query("stuck_jobs", STUCK_SQL)
def stuck_jobs(spark, sf_dir):
    """Jobs silent for a week before the newest event of all."""
    events = view(spark, sf_dir, "status_events")
    newest = events.agg(F.max(epoch_micros(events, "ts"))).first()[0] or 0
    return reports.stuck_jobs(events, CUTOFF_SECONDS, F.lit(newest))


@query(
    "pass_rate",
    """select kind, source, cast(grouping(kind, source) as int) as level, count(*) as documents,
  count(*) filter (passes) as passed, count(*) filter (passes) / count(*) as rate
from (select case when ext = 'pdf' then 'pdf' when ext = 'xlsx' then 'sheet' when ext = 'docx' then 'word'
    when ext = 'png' then 'image' else 'other' end as kind, source, passes
  from (select lower(split_part(j.filename, '.', -1)) as ext, s.c_mktsegment as source,
      coalesce(c.confidence, 1.0) * 100 >= 95.0 as passes
    from jobs j join conf c on c.doc_id = j.job_id
      join (select o_orderkey, c_mktsegment from orders o join customer u on u.c_custkey = o.o_custkey) s
        on s.o_orderkey = j.job_id) f) k
group by cube (kind, source)""",
)
def pass_rate(spark, sf_dir):
    """The source of a document is the market segment of the customer it comes from."""
    named = view(spark, sf_dir, "jobs").select(F.col("job_id").alias("doc_id"), "filename")
    passes = quality.passes_gate(quality.confidence_or_default(F.col("confidence"))).alias("passes")
    known = view(spark, sf_dir, "conf").select("doc_id", passes)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("source"))
    return reports.pass_rate(named.join(known, "doc_id").join(orders, "doc_id").join(customers, "o_custkey"))


@query(
    "kv_schema",
    P.steps(
        P.MODEL,
        select="""select key, case json_type(raw) when 'VARCHAR' then 'STRING' when 'UBIGINT' then 'BIGINT'
  when 'BIGINT' then 'BIGINT' when 'BOOLEAN' then 'BOOLEAN' when 'NULL' then 'VOID'
  when 'ARRAY' then case when raw::varchar = '[]' then 'ARRAY<VOID>' else 'ARRAY<VOID>' end
  when 'OBJECT' then 'OBJECT<>' end as kind, count(*) as documents
from entries group by all""",
    ),
)
def kv_schema(spark, sf_dir):
    """The fields that the model's answers have, with the types of their values."""
    answers = view(spark, sf_dir, "llm")
    entries = answers.select(F.explode(model.parse_response(F.col("response"))).alias("entry"))
    return reports.field_types(entries.select("entry.key", "entry.value"))


@query(
    "kv_pivot",
    P.steps(
        P.kv_steps("forms", "doc_id"),
        select="select doc_id, "
        + ", ".join(f"max(val) filter (key = '{k}') as {n}" for k, n in PIVOT.items())
        + f" from kv where key in ({', '.join(repr(k) for k in PIVOT)}) group by doc_id",
    ),
)
def kv_pivot(spark, sf_dir):
    return reports.pivot_fields(extraction.field_rows(view(spark, sf_dir, "forms")), ["doc_id"], PIVOT)


@query(
    "clean_impact",
    f"""select lang, source, count(*) as documents, cast(sum(length(text)) as bigint) as raw_chars,
  cast(sum(length(text) - length(cleaned)) as bigint) as removed_chars, cast(sum(rules) as bigint) as rule_lines
from (select lang, source, text, {P.cleaned_of('text')} as cleaned,
    len(list_filter({P.lines_of('text')}, lambda l: regexp_matches(l, {P.RULE}))) as rules from documents) d
group by all""",
)
def clean_impact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "source", "text")
    return reports.clean_impact(docs, "lang", "source")
