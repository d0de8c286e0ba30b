"""Queries over converted documents: model fields, tables, quality, results, ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import grids, model, quality
from docloom.functions.times import epoch_micros
from docloom.operators import enrichment, extraction, results, tables
from docloom.operators.layout import explode_rows
from docloom.plans import sql_parts as P
from docloom.plans.registry import query
from docloom.plans.views import table, view
from docloom.session import shared_dir
from docloom.sources import sinks

# ---- model side ------------------------------------------------------------------------------

_CLEANED_DOCS = P.cleaned("documents", "doc_id")
_CUT = """left(cleaned_text, 2000) || case when length(cleaned_text) > 2000 then concat(chr(10), '[truncated]') else '' end"""
_PROMPT = "concat('" + model.USER_PROMPT.replace("'", "''") + f"', {_CUT})"


def _cleaned_documents(spark, sf_dir) -> DataFrame:
    return extraction.clean(table(spark, sf_dir, "documents", "documents").select("doc_id", "text"))


@query("llm_truncate", P.steps(_CLEANED_DOCS, select=f"select doc_id, {_CUT} as shown from cleaned"))
def llm_truncate(spark, sf_dir):
    docs = _cleaned_documents(spark, sf_dir)
    return docs.select("doc_id", model.truncate(F.col("cleaned_text")).alias("shown"))


@query("llm_prompt", P.steps(_CLEANED_DOCS, select=f"select doc_id, {_PROMPT} as prompt from cleaned"))
def llm_prompt(spark, sf_dir):
    docs = _cleaned_documents(spark, sf_dir)
    return docs.select("doc_id", model.prompt(F.col("cleaned_text")).alias("prompt"))


_REQUEST = f"""cast(to_json({{'model': 'qwen2.5:latest', 'messages': [
    {{'role': 'system', 'content': '{model.SYSTEM_PROMPT}'}}, {{'role': 'user', 'content': {_PROMPT}}}],
  'stream': false, 'keep_alive': '10m',
  'options': {{'temperature': 0, 'num_predict': 800, 'num_ctx': 2048, 'num_gpu': 99}}}}) as varchar)"""


@query("llm_requests", P.steps(_CLEANED_DOCS, select=f"select doc_id, {_REQUEST} as request from cleaned"))
def llm_requests(spark, sf_dir):
    return enrichment.requests(_cleaned_documents(spark, sf_dir))


@query(
    "llm_enrich",
    P.steps(
        _CLEANED_DOCS,
        select=f"""select doc_id, case when instr(shown, '[truncated]') = 0
    then concat('{{"chars": ', cast(length(shown) as varchar), '}}') end as response
  from (select doc_id, {_CUT} as shown from cleaned) s""",
    ),
)
def llm_enrich(spark, sf_dir):
    """All documents through a stand-in client that fails on truncated ones."""

    def client_factory():
        import json

        head = len(model_head)

        def client(body: str) -> str:
            shown = json.loads(body)["messages"][1]["content"][head:]
            if shown.endswith("[truncated]"):
                raise TimeoutError("too long")
            return json.dumps({"chars": len(shown)})

        return client

    model_head = model.USER_PROMPT
    requests = enrichment.requests(_cleaned_documents(spark, sf_dir))
    slots = spark.sparkContext.defaultParallelism
    return enrichment.respond(requests, client_factory, concurrency=slots)


@query(
    "llm_parse",
    P.steps(P.MODEL, select="select doc_id, key, val from flagged"),
)
def llm_parse(spark, sf_dir):
    return enrichment.model_fields(view(spark, sf_dir, "llm")).select("doc_id", "key", "val")


@query(
    "llm_prune",
    P.steps(P.MODEL, select="select doc_id, key, val from flagged where not is_blank"),
)
def llm_prune(spark, sf_dir):
    found = enrichment.model_fields(view(spark, sf_dir, "llm"))
    return found.filter(~F.col("is_blank")).select("doc_id", "key", "val")


# ---- tables ----------------------------------------------------------------------------------


def grid_of(text: Column) -> Column:
    """Lines as tables, sentences as rows, commas between cells; a blank line is an empty table."""

    def rows(line: Column) -> Column:
        return F.transform(
            F.filter(F.split(line, r"\. "), lambda r: r != ""), lambda r: F.split(r, ",")
        )

    return F.transform(F.split(text, "\n"), rows)


_GRID = """list_transform(string_split(text, chr(10)), lambda l: list_transform(
    list_filter(string_split(l, '. '), lambda r: r <> ''), lambda r: string_split(r, ',')))"""
_TABLES = f"list_filter({_GRID}, lambda t: len(t) > 0)"
_GRID_TABLES = f"""g as (select doc_id, {_TABLES} as tables from documents),
t as (select doc_id, unnest(tables) as t, generate_subscripts(tables, 1) as table_idx from g)"""


def _documents_with_tables(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "documents")
    return docs.select("doc_id", grid_of(F.col("text")).alias("tables"))


@query(
    "grid_nonempty",
    P.steps(
        _GRID_TABLES,
        select="select doc_id, cast(table_idx as int) as table_idx, cast(len(t) as int) as n_rows from t",
    ),
)
def grid_nonempty(spark, sf_dir):
    return tables.nonempty_tables(_documents_with_tables(spark, sf_dir))


@query(
    "tables_found",
    P.steps(_GRID_TABLES, select="select doc_id, cast(len(tables) as int) as tables_found from g"),
)
def tables_found(spark, sf_dir):
    docs = _documents_with_tables(spark, sf_dir)
    return docs.select("doc_id", grids.tables_found(F.col("tables")).alias("tables_found"))


@query(
    "grid_cells",
    P.steps(
        _GRID_TABLES,
        """r as (select doc_id, table_idx, unnest(t) as r, generate_subscripts(t, 1) as row_idx from t)""",
        select="""select doc_id, cast(table_idx as int) as table_idx, cast(row_idx as int) as row_idx,
  cast(generate_subscripts(r, 1) as int) as col_idx, unnest(r) as cell from r""",
    ),
)
def grid_cells(spark, sf_dir):
    return tables.cells(_documents_with_tables(spark, sf_dir))


@query(
    "grid_cells_preview",
    P.steps(
        _GRID_TABLES,
        """p as (select doc_id, table_idx, t[1:10] as t from t)""",
        """r as (select doc_id, table_idx, unnest(t) as r, generate_subscripts(t, 1) as row_idx from p)""",
        select="""select doc_id, cast(table_idx as int) as table_idx, cast(row_idx as int) as row_idx,
  cast(generate_subscripts(r, 1) as int) as col_idx, unnest(r) as cell from r""",
    ),
)
def grid_cells_preview(spark, sf_dir):
    docs = _documents_with_tables(spark, sf_dir)
    return tables.cells(docs.withColumn("tables", grids.preview(F.col("tables"))))


_LINE_ORDER = [
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
]


@query(
    "grid_preview",
    f"""select doc_id, cast(row_idx as int) as row_idx, row_idx = 1 as is_header, c0, c1, c2
from (select *, row_number() over (partition by doc_id order by {', '.join(_LINE_ORDER)}) as row_idx
  from line_rows) n where row_idx <= 10""",
)
def grid_preview(spark, sf_dir):
    rows = tables.preview_rows(view(spark, sf_dir, "line_rows"), ["doc_id"], _LINE_ORDER)
    return rows.select("doc_id", "row_idx", "is_header", "c0", "c1", "c2")


# ---- quality ---------------------------------------------------------------------------------


@query(
    "confidence_default",
    "select doc_id, coalesce(try_cast(confidence as double), 1.0) as confidence from conf_text",
)
def confidence_default(spark, sf_dir):
    return view(spark, sf_dir, "conf_text").select(
        "doc_id", quality.confidence_or_default(F.col("confidence")).alias("confidence")
    )


def _scored(spark, sf_dir) -> DataFrame:
    known = view(spark, sf_dir, "conf").select(
        "doc_id", quality.confidence_or_default(F.col("confidence")).alias("confidence")
    )
    return known.select(
        "doc_id",
        quality.quality_score(F.col("confidence")).alias("score"),
        quality.passes_gate(F.col("confidence")).alias("passes"),
    )


@query("quality_score", P.steps(P.SCORE, select="select doc_id, score from scored"))
def quality_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "score")


@query(
    "quality_gate",
    """select doc_id, not isnan(c) and c * 100 >= 95.0 as passes
from (select doc_id, coalesce(try_cast(confidence as double), 1.0) as c from conf_text) t""",
)
def quality_gate(spark, sf_dir):
    confidence = quality.confidence_or_default(F.col("confidence"))
    return view(spark, sf_dir, "conf_text").select("doc_id", quality.passes_gate(confidence).alias("passes"))


@query(
    "quality_card",
    P.steps(
        P.SCORE,
        select="""select s.doc_id,
  case when k.confidence is null then 0.0 else least(score, 100.0) end as bar,
  case when k.confidence is null then '—' else concat(cast(cast(score as decimal(5,1)) as varchar), '%') end as score_text,
  case when c * 100 >= 95.0 then '✓ LULUS (≥95%)' else '✗ PERLU PERBAIKAN (<95%)' end as label
from scored s join conf k on k.doc_id = s.doc_id""",
    ),
)
def quality_card(spark, sf_dir):
    """A document without confidence shows no score here, as a stored null score would."""
    known = view(spark, sf_dir, "conf")
    confidence = quality.confidence_or_default(F.col("confidence"))
    score = F.when(F.col("confidence").isNotNull(), quality.quality_score(confidence))
    return known.select("doc_id", score.alias("score"), quality.passes_gate(confidence).alias("p")).select(
        "doc_id",
        quality.bar_value(F.col("score")).alias("bar"),
        quality.score_text(F.col("score")).alias("score_text"),
        quality.gate_label(F.col("p")).alias("label"),
    )


# ---- results ---------------------------------------------------------------------------------


def converted(spark, sf_dir) -> DataFrame:
    """All forms as converted documents, with their job's file name, key and times."""
    docs = view(spark, sf_dir, "converted")
    return docs.withColumn("tables", grid_of(F.col("text")))


def built(spark, sf_dir) -> DataFrame:
    return results.build(converted(spark, sf_dir), view(spark, sf_dir, "llm"))


_RESULT = ",\n".join(
    [
        P.kv_steps("forms", "doc_id"),
        P.MODEL,
        P.SCORE,
        f"""counted as (select doc_id, cast(count(*) as int) as n from kv group by doc_id),
res as (select j.job_id, d.doc_id, j.filename, j.created_at, d.cleaned_text, cast(length(d.text) as int) as raw_chars,
  cast(length(d.cleaned_text) as int) as clean_chars, s.score as doc_confidence, s.c * 100 >= 95.0 as passes,
  (select cast(len({_TABLES}) as int)) as tables_found,
  ai.ai_fields is not null as ai_extraction, cast(coalesce(ai.ai_fields, 0) as int) as ai_fields,
  cast(case when ai.ai_fields is not null then ai.kept else coalesce(n.n, 0) end as int) as kv_found
from cleaned d join jobs j on j.job_id = d.doc_id join scored s on s.doc_id = d.doc_id
  left join ai on ai.doc_id = d.doc_id left join counted n on n.doc_id = d.doc_id)""",
    ]
)
_FLAT = (
    "filename",
    "raw_chars",
    "clean_chars",
    "doc_confidence",
    "tables_found",
    "kv_found",
    "passes",
    "ai_extraction",
)


@query("doc_result", P.steps(_RESULT, select=f"select doc_id, {', '.join(_FLAT)} from res"))
def doc_result(spark, sf_dir):
    return built(spark, sf_dir).select("doc_id", *_FLAT)


@query(
    "extract_choose",
    P.steps(
        _RESULT,
        select="""select doc_id, true as ai_extraction, key, val from flagged where not is_blank
    and doc_id in (select doc_id from res)
  union all select kv.doc_id, false as ai_extraction, key, val from kv join res on res.doc_id = kv.doc_id
    where not res.ai_extraction""",
    ),
)
def extract_choose(spark, sf_dir):
    chosen = explode_rows(
        built(spark, sf_dir), ["doc_id", "ai_extraction"], F.map_entries("key_values"), "field_no", "field"
    )
    value = F.col("field.value").cast("string")
    return chosen.select("doc_id", "ai_extraction", F.col("field.key").alias("key"), value.alias("val"))


@query(
    "provenance",
    P.steps(
        _RESULT,
        select="""select doc_id, ai_extraction, case when ai_extraction then kv_found end as ai_result_fields,
  case when ai_extraction then 'Qwen AI' else 'Regex' end as source from res""",
    ),
)
def provenance(spark, sf_dir):
    kept = F.when(F.col("ai_result").isNotNull(), F.size("ai_result.key_values"))
    return built(spark, sf_dir).select(
        "doc_id",
        "ai_extraction",
        kept.alias("ai_result_fields"),
        model.source_label(F.col("ai_extraction")).alias("source"),
    )


#: What is read of a stored result.
_STORED = """cleaned_text string, doc_confidence double, kv_found string, passes string,
  key_values struct<Customer: string>, pipeline_steps array<struct<detail: string>>"""


@query(
    "completed_rows",
    P.steps(
        _RESULT,
        select="""select job_id, 'completed' as status, cast(raw_chars * 3 as int) as elapsed_ms, created_at as completed_at,
  cleaned_text, doc_confidence, cast(kv_found as varchar) as kv_found, cast(passes as varchar) as passes,
  (select val from kv where kv.doc_id = res.doc_id and key = 'Customer' and not res.ai_extraction) as customer,
  case when ai_extraction then concat(cast(ai_fields as varchar), ' fields') else 'Using regex fallback' end as step_detail,
  not ai_extraction as ai_result_is_null from res""",
    ),
)
def completed_rows(spark, sf_dir):
    """The stored JSON of each result, written, read back and taken apart again."""
    done = built(spark, sf_dir).withColumns(
        {"elapsed_ms": (F.col("raw_chars") * 3).cast("int"), "completed_at": F.col("created_at")}
    )
    path = shared_dir(spark, "results")
    sinks.save_by_date(results.completed_rows(done), path, "completed_at", "year")
    stored = spark.read.parquet(path)

    # each text is parsed once, for all members that are read; a generator keeps the parser from running for each
    parsed = F.from_json("result", _STORED)
    ai_result_is_null = F.contains("result", F.lit('"ai_result":null')).alias("ai_result_is_null")
    kept = ("job_id", "status", "elapsed_ms", "completed_at")
    return stored.select(*kept, ai_result_is_null, F.inline_outer(F.array(parsed))).select(
        *kept,
        "cleaned_text",
        "doc_confidence",
        "kv_found",
        "passes",
        F.col("key_values.Customer").alias("customer"),
        F.get("pipeline_steps", F.lit(5))["detail"].alias("step_detail"),
        "ai_result_is_null",
    )


_LEDGER = """ledger as (
  select doc_id, job_id, created_at, 1 as entry_no, 'OCR' as step, 'running' as status, 'Reading document...' as detail from res
  union all select doc_id, job_id, created_at, 2, 'OCR', 'ok', concat(raw_chars, ' chars, ', doc_confidence, '%') from res
  union all select doc_id, job_id, created_at, 3, 'Clean Text', 'running', 'Cleaning...' from res
  union all select doc_id, job_id, created_at, 4, 'Clean Text', 'ok', concat(raw_chars, ' → ', clean_chars, ' chars') from res
  union all select doc_id, job_id, created_at, 5, 'Qwen', 'running', 'Extracting with AI...' from res
  union all select doc_id, job_id, created_at, 6, 'Qwen', case when ai_extraction then 'ok' else 'fallback' end,
    case when ai_extraction then concat(ai_fields, ' fields') else 'Using regex fallback' end from res
  union all select doc_id, job_id, created_at, 7, 'Validate JSON', 'running', 'Validating...' from res
  union all select doc_id, job_id, created_at, 8, 'Validate JSON', case when ai_extraction then 'ok' else 'skip' end,
    case when ai_extraction then concat(kv_found, ' fields extracted') else 'No AI result' end from res)"""


@query(
    "step_ledger",
    P.steps(_RESULT, _LEDGER, select="select doc_id, entry_no, step, status, detail from ledger"),
)
def step_ledger(spark, sf_dir):
    return results.ledger_rows(built(spark, sf_dir), "doc_id")


@query(
    "step_overview",
    P.steps(
        _RESULT,
        _LEDGER,
        select="""select doc_id, entry_no // 2 as label_no, step as label, status as step_status, detail
  from ledger where entry_no in (2, 4, 6, 8)
union all select doc_id, 5, 'Database', 'ok', 'tersimpan' from res""",
    ),
)
def step_overview(spark, sf_dir):
    return results.step_overview(built(spark, sf_dir), "doc_id")


@query(
    "emit_events",
    P.steps(
        _RESULT,
        _LEDGER,
        select="""select job_id, 0 as seq, 'processing' as status, 'OCR' as step, null as step_status, null as detail,
  null as elapsed_ms, cast(epoch(created_at) as double) as timestamp from res
union all select job_id, entry_no * 2 - 1, 'processing', step, null, null, null, cast(epoch(created_at) as double) from ledger
union all select job_id, entry_no * 2, 'processing', step, status, detail, null, cast(epoch(created_at) as double) from ledger
union all select job_id, 17, 'completed', null, null, null, cast(raw_chars * 3 as int), cast(epoch(created_at) as double)
  from res""",
    ),
)
def emit_events(spark, sf_dir):
    records = built(spark, sf_dir)
    finished = records.withColumns(
        {
            "elapsed_ms": (F.col("raw_chars") * 3).cast("int"),
            "started_at": epoch_micros(records, "created_at") / 1_000_000,
        }
    )
    return results.emit_events(finished).drop("elapsed_s", "error")
