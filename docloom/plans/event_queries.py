"""Queries over status events, in batch and as streams."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import schemas as S
from docloom.functions.times import epoch_micros
from docloom.operators import admission, status
from docloom.plans import document_queries as docs
from docloom.plans import sql_parts as P
from docloom.plans.registry import query
from docloom.plans.report_queries import CUTOFF_SECONDS, STUCK_SQL
from docloom.plans.views import view
from docloom.session import shared_dir
from docloom.sources import files as file_source
from docloom.sources import sinks
from docloom.sources.job_table import JobTable
from docloom.sources.keyed import KeyedTable, append_dealt, save_keyed
from docloom.streaming import queries as streams

BYTES_PER_TRIGGER = 64 << 20  # what a micro-batch of a landed input takes in
KEYED_PARTS = 16  # folders of a table that micro-batches look up; a large corpus takes thousands


def _events(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "status_events").drop("event_id")


def _landed(spark, rows: DataFrame, purpose: str) -> DataFrame:
    """``rows`` written to a landing folder and opened as a stream."""
    path = shared_dir(spark, purpose)
    sinks.append(rows, path)
    return _opened(spark, path, rows)


def _opened(spark, path: str, rows: DataFrame) -> DataFrame:
    return file_source.event_stream(spark, path, schema=rows.schema, bytes_per_trigger=BYTES_PER_TRIGGER)


def _queued(spark, messages: DataFrame) -> DataFrame:
    """Messages landed as a queue that is split by the folders of their files, and opened as a stream."""
    path = shared_dir(spark, "queue")
    append_dealt(messages, path, "file_key", KEYED_PARTS)
    return _opened(spark, path, messages)


def _keyed(spark, rows: DataFrame, key: str, purpose: str) -> KeyedTable:
    """``rows`` written by a hash of their key, so that a micro-batch reads the part it asks for."""
    return save_keyed(rows, shared_dir(spark, purpose), key, KEYED_PARTS)


def _finish(query) -> None:
    try:
        query.awaitTermination()
    finally:
        query.stop()


# ---- parsing and folds -----------------------------------------------------------------------


@query(
    "event_parse",
    """select event_id, body ->> '$.job_id' as job_id, body ->> '$.status' as status, body ->> '$.step' as step,
  cast(body ->> '$.elapsed_ms' as int) as elapsed_ms, body ->> '$.error' as error
from (select event_id, case when json_valid(value) then value::json end as body from event_messages) m
where json_type(body) = 'OBJECT'""",
)
def event_parse(spark, sf_dir):
    parsed = status.parse_events(view(spark, sf_dir, "event_messages"))
    return parsed.select("event_id", "job_id", "status", "step", "elapsed_ms", "error")


@query(
    "event_sink",
    "select job_id, seq, status, step, step_status, detail, elapsed_ms, error from status_events",
)
def event_sink(spark, sf_dir):
    """Events written as JSON lines, read back and parsed."""
    path = shared_dir(spark, "events-json")
    sinks.append_event_json(_events(spark, sf_dir).drop("ts"), path)
    lines = spark.read.text(path)
    seq = F.get_json_object("value", "$.seq").cast("bigint").alias("seq")
    parsed = status.parse_events(lines.select(seq, "value"))
    return parsed.drop("elapsed_s", "timestamp")


_CURRENT = """select job_id, arg_max(status, seq) as status, arg_max(step, seq) filter (coalesce(step, '') <> '') as step,
  arg_max(coalesce(nullif(error, ''), 'Job failed'), seq) filter (status = 'failed') as error, max(seq) as last_seq
from status_events group by job_id"""


@query("job_current", _CURRENT)
def job_current(spark, sf_dir):
    return status.current_state(_events(spark, sf_dir))


@query(
    "job_steps",
    """select job_id, cast(row_number() over (partition by job_id order by first_seq) as int) as step_no, step,
  step_status, detail
from (select job_id, step, min(seq) as first_seq, arg_max(step_status, seq) as step_status,
    arg_max(coalesce(detail, ''), seq) as detail
  from status_events where step_status is not null group by job_id, step) s""",
)
def job_steps(spark, sf_dir):
    return status.step_list(_events(spark, sf_dir)).drop("elapsed_s")


_CUT = """closed as (select job_id, min(seq) as closed_at from status_events
  where status in ('completed', 'failed') group by job_id),
cut as (select e.* from status_events e left join closed c on c.job_id = e.job_id
  where c.closed_at is null or e.seq <= c.closed_at)"""
_EVENT_COLUMNS = ("job_id", "seq", "status", "step", "step_status", "error")
_CUT_SQL = P.steps(_CUT, select=f"select {', '.join(_EVENT_COLUMNS)} from cut")


@query("terminal_cut", _CUT_SQL)
def terminal_cut(spark, sf_dir):
    return status.terminal_cut(_events(spark, sf_dir)).select(*_EVENT_COLUMNS)


@query(
    "job_channel",
    """select concat('job:', job_id, ':status') as channel, job_id, seq, status, step from status_events
where job_id in (select job_id from status_events where status = 'failed')""",
)
def job_channel(spark, sf_dir):
    """The channels of all jobs that reported a failure."""
    events = _events(spark, sf_dir)
    failing = events.filter(F.col("status") == S.FAILED).select("job_id").distinct()
    return status.subscribed(events, failing).select("channel", "job_id", "seq", "status", "step")


_SNAPSHOT_TAIL = """with snaps as (select job_id, arg_min(status, seq) as status,
    arg_min(struct_pack(s := coalesce(step, '')), seq).s as step from status_events group by job_id),
seen as (select job_id, -1 as seq, status, step, null as error from snaps
  union all select job_id, seq, status, step, error from status_events),
ends as (select job_id, min(seq) as closed_at from seen where status in ('completed', 'failed') group by job_id)
select s.job_id, s.seq, s.status, s.step, s.error from seen s left join ends e on e.job_id = s.job_id
where e.closed_at is null or s.seq <= e.closed_at"""


def _opening_states(events: DataFrame) -> DataFrame:
    """The state of each job at its first event."""
    opening = F.min_by(F.struct("status", "step"), "seq")
    return events.groupBy("job_id").agg(opening.alias("s")).select(
        "job_id", "s.status", F.coalesce("s.step", F.lit("")).alias("step")
    )


@query("snapshot_tail", _SNAPSHOT_TAIL)
def snapshot_tail(spark, sf_dir):
    """Each job seen from its first event on: that state as snapshot, then all its events."""
    events = _events(spark, sf_dir)
    return status.snapshot_then_tail(_opening_states(events), events).select("job_id", "seq", "status", "step", "error")


_UPSERT = """with f as (select job_id, arg_max(status, seq) as status, arg_max(ts, seq) as updated_at,
    arg_max(struct_pack(v := step), seq) filter (status = 'processing') as step,
    arg_max(struct_pack(v := error), seq) filter (status = 'failed') as error,
    arg_max(struct_pack(e := elapsed_ms, t := ts), seq) filter (status = 'completed') as done
  from status_events group by job_id)
select j.job_id, j.filename, j.file_key, j.file_size, f.status, f.step.v as current_step, f.error.v as error,
  f.done.e as elapsed_ms, j.created_at, f.updated_at, f.done.t as completed_at
from event_jobs j join f on f.job_id = j.job_id"""


@query("job_upsert", _UPSERT)
def job_upsert(spark, sf_dir):
    return status.upsert_jobs(view(spark, sf_dir, "event_jobs"), _events(spark, sf_dir))


@query(
    "step_elapsed",
    f"""select job_id, step, {P.round_binary('s', 2)} as elapsed_s
from (select job_id, step, (max(epoch_us(ts)) filter (step_status <> 'running')
    - min(epoch_us(ts)) filter (step_status = 'running')) / 1000000 as s
  from status_events where step_status is not null group by job_id, step) t""",
)
def step_elapsed(spark, sf_dir):
    return status.step_elapsed(_events(spark, sf_dir))


@query(
    "job_elapsed",
    f"""select job_id, case when e >= b then e - b end as elapsed_ms,
  case when e >= b then {P.round_binary('((e - b) / 1000)', 2)} end as elapsed_s
from (select job_id, min(epoch_us(ts) // 1000) filter (status = 'processing') as b,
    min(epoch_us(ts) // 1000) filter (status in ('completed', 'failed')) as e
  from status_events group by job_id) t""",
)
def job_elapsed(spark, sf_dir):
    return status.job_elapsed(_events(spark, sf_dir))


@query(
    "step_matrix",
    """with labels(label_no, label) as (values (1, 'OCR'), (2, 'Clean Text'), (3, 'Qwen'), (4, 'Validate JSON'), (5, 'Database')),
last as (select job_id, step, arg_max(step_status, seq) as step_status, arg_max(coalesce(detail, ''), seq) as detail
  from status_events where step_status is not null group by job_id, step)
select j.job_id, l.label_no, l.label,
  coalesce(s.step_status, case when l.label = 'Database' then 'ok' else 'skip' end) as step_status,
  coalesce(s.detail, case when l.label = 'Database' then 'tersimpan' else 'dilewati' end) as detail
from (select distinct job_id from status_events) j cross join labels l
  left join last s on s.job_id = j.job_id and s.step = l.label""",
)
def step_matrix(spark, sf_dir):
    return status.step_matrix(_events(spark, sf_dir))


# ---- streams ---------------------------------------------------------------------------------


@query(
    "queue_stream",
    """select cast(job_id as string) as job_id, filename, concat('uploads/', cast(job_id as string), '/', filename) as file_key
from uploads where filename is not null and file_size <= 20971520""",
)
def queue_stream(spark, sf_dir):
    """All queue messages, read as a stream of micro-batches."""
    messages = admission.queue_messages(admission.register(view(spark, sf_dir, "uploads")))
    landed = _landed(spark, messages, "queue")
    out = shared_dir(spark, "queue-read")
    writer = landed.writeStream.option("checkpointLocation", shared_dir(spark, "checkpoint"))
    _finish(writer.trigger(availableNow=True).format("parquet").start(out))
    return spark.read.schema(messages.schema).parquet(out)


def _run_jobs(spark, sf_dir) -> DataFrame:
    converted = docs.converted(spark, sf_dir)
    messages = admission.queue_messages(converted)
    landed = _queued(spark, messages)
    out = shared_dir(spark, "results")
    static = _keyed(spark, converted.drop("job_id", "filename", "created_at"), "file_key", "converted")
    answers = _keyed(spark, view(spark, sf_dir, "llm"), "doc_id", "answers")
    _finish(streams.run_jobs(landed, static, answers, out, shared_dir(spark, "checkpoint")))
    return spark.read.parquet(out)


@query(
    "stream_results",
    P.steps(docs._RESULT, select=f"select cast(job_id as varchar) as job_id, doc_id, {', '.join(docs._FLAT)} from res"),
)
def stream_results(spark, sf_dir):
    """All forms through the streaming form of ``doc_result``."""
    stored = sinks.latest_per_job(_run_jobs(spark, sf_dir))
    return stored.select("job_id", "doc_id", *docs._FLAT)


@query(
    "stream_jobs",
    """select cast(job_id as varchar) as job_id, filename, case when error is null then 'completed' else 'failed' end as status,
  case when error is null then 'Validate JSON' else 'OCR' end as current_step, error,
  error is null as has_elapsed, error is null as has_completed_at
from (select j.job_id, j.filename, case when o.file_key is null then concat('Storage download failed: ', j.file_key)
    when j.job_id % 11 = 4 then concat('ValueError: page ', cast(j.job_id as varchar), ' is broken') end as error
  from jobs j left join objects o on o.file_key = j.file_key) e""",
)
def stream_jobs(spark, sf_dir):
    """Queue to job table: all jobs run as a stream, their events folded into their rows. Documents that are
    missing or cannot be converted fail with their error, all others finish."""
    stored = view(spark, sf_dir, "objects").select("file_key")
    broken = F.col("doc_id") % 11 == 4
    every = docs.converted(spark, sf_dir).withColumns(
        {
            "error_type": F.when(broken, "ValueError"),
            "error_message": F.when(broken, F.concat(F.lit("page "), F.col("doc_id").cast("string"), F.lit(" is broken"))),
        }
    )
    registered = view(spark, sf_dir, "jobs").select(
        F.col("job_id").cast("string").alias("job_id"), "filename", "file_key"
    )
    landed = _queued(spark, admission.queue_messages(registered))
    out, events_out, changes_out = (shared_dir(spark, p) for p in ("results", "events", "changes"))
    held = every.drop("job_id", "filename", "created_at").join(stored, "file_key", "left_semi")
    static = _keyed(spark, held, "file_key", "converted")
    answers = _keyed(spark, view(spark, sf_dir, "llm"), "doc_id", "answers")
    checkpoint = shared_dir(spark, "checkpoint")
    _finish(streams.run_jobs(landed, static, answers, out, checkpoint, events_out, changes_out=changes_out))
    queued = registered.withColumns(
        {
            "status": F.lit(S.QUEUED),
            "current_step": F.lit(None).cast("string"),
            "error": F.lit(None).cast("string"),
            "elapsed_ms": F.lit(None).cast("int"),
            "updated_at": F.lit(None).cast("timestamp"),
            "completed_at": F.lit(None).cast("timestamp"),
        }
    )
    rows = status.apply_changes(queued, streams.latest_changes(spark.read.parquet(changes_out)))
    return rows.select(
        "job_id",
        "filename",
        "status",
        "current_step",
        "error",
        F.col("elapsed_ms").isNotNull().alias("has_elapsed"),
        F.col("completed_at").isNotNull().alias("has_completed_at"),
    )


@query("stream_current", _CURRENT)
def stream_current(spark, sf_dir):
    landed = _landed(spark, _events(spark, sf_dir), "events")
    out = shared_dir(spark, "states")
    _finish(streams.follow_state(landed, out, shared_dir(spark, "checkpoint")))
    return sinks.latest_states(spark.read.parquet(out)).select("job_id", "status", "step", "error", "last_seq")


@query("stream_terminal_cut", _CUT_SQL)
def stream_terminal_cut(spark, sf_dir):
    landed = _landed(spark, _events(spark, sf_dir), "events")
    out = shared_dir(spark, "passed")
    _finish(streams.follow_until_closed(landed, out, shared_dir(spark, "checkpoint"), groups=streams.JOB_GROUPS))
    return streams.read_until_closed(spark.read.parquet(out)).select(*_EVENT_COLUMNS)


@query("stream_snapshot_tail", _SNAPSHOT_TAIL)
def stream_snapshot_tail(spark, sf_dir):
    """The streaming form of ``snapshot_tail``."""
    events = _events(spark, sf_dir)
    landed = _landed(spark, events, "events")
    path = shared_dir(spark, "snapshots")
    sinks.append(_opening_states(events), path)
    out = shared_dir(spark, "seen")
    _finish(streams.follow_snapshot_tail(spark.read.parquet(path), landed, out, shared_dir(spark, "checkpoint")))
    return streams.read_snapshot_tail(spark.read.parquet(out)).select("job_id", "seq", "status", "step", "error")


@query("stream_stuck_jobs", STUCK_SQL)
def stream_stuck_jobs(spark, sf_dir):
    """The streaming form of ``stuck_jobs``: jobs told to be silent, as of the newest event."""
    events = _events(spark, sf_dir)
    landed = _landed(spark, events, "events")
    out = shared_dir(spark, "silence")
    _finish(streams.follow_silence(landed, out, shared_dir(spark, "checkpoint"), CUTOFF_SECONDS))
    newest = events.agg(F.max(epoch_micros(events, "ts"))).first()[0] or 0
    return streams.read_silence(spark.read.parquet(out), CUTOFF_SECONDS, F.lit(newest))


@query("job_table", _UPSERT)
def job_table(spark, sf_dir):
    """Job rows of a table that the stream adds deltas to: the first half folded in, the rest on top."""
    events = _events(spark, sf_dir)
    jobs = view(spark, sf_dir, "event_jobs")
    table = JobTable(shared_dir(spark, "job-table"), KEYED_PARTS, jobs.schema)
    table.create(jobs)
    path, checkpoint = shared_dir(spark, "events"), shared_dir(spark, "checkpoint")
    middle = (events.agg(F.max("seq")).first()[0] or 0) // 2
    for part, fold_every in ((F.col("seq") <= middle, 1), (F.col("seq") > middle, 1000)):
        sinks.append(events.filter(part), path)
        _finish(streams.follow_into_table(_opened(spark, path, events), table, checkpoint, fold_every=fold_every))
    return table.read(spark)


@query("replay_idempotent", _UPSERT)
def replay_idempotent(spark, sf_dir):
    """Job rows after all batches were written, the checkpoint lost, and all written again."""
    landed = _landed(spark, _events(spark, sf_dir), "events")
    out = shared_dir(spark, "changes")
    for _ in range(2):
        _finish(streams.follow_changes(landed, out, shared_dir(spark, "checkpoint")))
    changes = status.merge_changes(spark.read.parquet(out).drop("generation", "batch_id"))
    return status.apply_changes(view(spark, sf_dir, "event_jobs"), changes)


@query(
    "replay_rebatched",
    P.steps(
        _CUT,
        select=f"""select 'state' as kind, job_id, last_seq as seq, status, step, error from ({_CURRENT}) s
union all select 'passed', job_id, seq, status, step, error from cut""",
    ),
)
def replay_rebatched(spark, sf_dir):
    """States and passed events after half the events were followed, the checkpoints lost, the rest
    landed, and all read again in other batches."""
    events = _events(spark, sf_dir)
    path = shared_dir(spark, "events")
    states, passed = (shared_dir(spark, p) for p in ("states", "passed"))
    middle = (events.agg(F.max("seq")).first()[0] or 0) // 2
    for part in (F.col("seq") <= middle, F.col("seq") > middle):
        sinks.append(events.filter(part), path)
        follow_cut = partial(streams.follow_until_closed, groups=streams.JOB_GROUPS)
        for start, out in ((streams.follow_state, states), (follow_cut, passed)):
            _finish(start(_opened(spark, path, events), out, shared_dir(spark, "checkpoint")))
    columns = ("job_id", "seq", "status", "step", "error")
    known = sinks.latest_states(spark.read.parquet(states)).withColumnRenamed("last_seq", "seq")
    cut = streams.read_until_closed(spark.read.parquet(passed))
    return known.select(F.lit("state").alias("kind"), *columns).unionByName(
        cut.select(F.lit("passed").alias("kind"), *columns)
    )
