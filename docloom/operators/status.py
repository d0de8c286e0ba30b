"""Folds over status events.

Events are rows ``(job_id, seq, status, step, step_status, …)`` where ``seq`` rises in arrival
order. Folds are ``max_by`` aggregations, so each map task sends one row per job on, and a job
that holds a large part of all events does not gather in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import schemas as S
from docloom.functions.rounding import round_binary
from docloom.functions.times import epoch_micros, seconds_between

# The error shown when a failed event names none, and the step overview's defaults.
DEFAULT_ERROR = "Job failed"
STEP_SKIPPED = ("skip", "dilewati")
STORE_DONE = ("ok", "tersimpan")
JSON_BLANKS = " \t\n\r"


def step_default(label: str) -> tuple[str, str]:
    """What the overview shows for a step that nothing was said about."""
    return STORE_DONE if label == S.STEP_STORE else STEP_SKIPPED


def is_terminal(status: Column) -> Column:
    return status.isin(*S.TERMINAL)


def _filled(text: Column) -> Column:
    """Null for a missing or empty text, which a viewer treats alike."""
    return F.when(text != "", text)


def parse_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON messages to event columns; malformed messages are dropped.

    The message is parsed inside a wrapper whose last member must be reached. Without it the
    reader would accept text after a complete object. The wrapper must hold the two members it was
    given and no more, so a message cannot bring members of its own. A field of the wrong type
    becomes null and the message stays.
    """
    body = F.btrim(F.col(column), F.lit(JSON_BLANKS))
    wrapped = F.concat(F.lit('{"message":'), body, F.lit(',"message_ends":true}'))
    parsed = F.from_json(
        wrapped,
        f"message {S.STATUS_EVENT.simpleString()}, message_ends boolean",
        {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"},
    )
    others = [c for c in raw.columns if c != column]
    # only a message that goes on behind a brace can have more than one member
    whole = ~F.rlike(body, F.lit(r"\}\s*,")) | (F.size(F.json_object_keys(wrapped)) == 2)
    # A cheap look at both ends spares the parser most damaged messages. The parsed message comes
    # out of a generator, since a filter on a computed column would compute it once more.
    return (
        raw.filter(F.startswith(body, F.lit("{")) & F.endswith(body, F.lit("}")) & whole)
        .select(*others, F.inline(F.array(parsed)))
        .filter(F.col("message_ends") & F.col("message").isNotNull())
        .select(*others, "message.*")
    )


def current_state(events: DataFrame) -> DataFrame:
    """Latest status, last non-empty step and last error per job."""
    return current_fold(events).select("job_id", "status", "step", "error", "last_seq")


def current_fold(events: DataFrame, *spans: Column) -> DataFrame:
    """E3 with the place of each value and the number of events, per job and, in a stream, per span of time.

    :func:`merge_folds` puts folds of different events of a job together.
    """
    seq, status = F.col("seq"), F.col("status")
    step = _filled(F.col("step"))
    error = F.coalesce(_filled(F.col("error")), F.lit(DEFAULT_ERROR))
    has_step, has_error = F.when(step.isNotNull(), seq), F.when(status == S.FAILED, seq)
    return events.groupBy("job_id", *spans).agg(
        F.max_by(status, seq).alias("status"),
        F.max_by(step, has_step).alias("step"),
        F.max(has_step).alias("step_seq"),
        F.max_by(error, has_error).alias("error"),
        F.max(has_error).alias("error_seq"),
        F.max(seq).alias("last_seq"),
        F.count(F.lit(1)).alias("n_events"),
    )


def merge_folds(folds: DataFrame) -> DataFrame:
    """One fold a job of folds of different events; merging merged ones gives the same."""
    return folds.groupBy("job_id").agg(
        F.max_by("status", "last_seq").alias("status"),
        F.max_by("step", "step_seq").alias("step"),
        F.max("step_seq").alias("step_seq"),
        F.max_by("error", "error_seq").alias("error"),
        F.max("error_seq").alias("error_seq"),
        F.max("last_seq").alias("last_seq"),
        F.sum("n_events").alias("n_events"),
    )


def _optional(df: DataFrame, name: str) -> Column:
    """A column of the event schema, null where ``df`` lacks it."""
    kind = S.STATUS_EVENT[name].dataType
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def step_list(events: DataFrame) -> DataFrame:
    """Last entry of each step of a job, in the order in which the steps first appeared.

    The numbering runs over one row per job and step, after the aggregation.
    """
    entry = F.struct(
        "step_status",
        F.coalesce(_optional(events, "detail"), F.lit("")).alias("detail"),
        _optional(events, "elapsed_s").alias("elapsed_s"),
    )
    latest = (
        events.filter(_filled(F.col("step_status")).isNotNull())
        .groupBy("job_id", "step")
        .agg(F.min("seq").alias("first_seq"), F.max_by(entry, F.col("seq")).alias("entry"))
    )
    order = Window.partitionBy("job_id").orderBy("first_seq")
    return latest.select(
        "job_id", F.row_number().over(order).alias("step_no"), "step", "entry.*"
    )


def closings(events: DataFrame) -> DataFrame:
    """``(job_id, closed_at)``: place of the first terminal event of each job that has one."""
    return (
        events.filter(is_terminal(F.col("status")))
        .groupBy("job_id")
        .agg(F.min("seq").alias("closed_at"))
    )


def cut_at(events: DataFrame, closed: DataFrame) -> DataFrame:
    """Events up to their job's closing. ``closed`` has one row per job, so a job with many
    events splits over tasks (skew join) instead of gathering in one window."""
    return (
        events.join(closed, "job_id", "left")
        .filter(F.col("closed_at").isNull() | (F.col("seq") <= F.col("closed_at")))
        .drop("closed_at")
    )


def terminal_cut(events: DataFrame) -> DataFrame:
    """E5: nothing after the first completed or failed event of a job."""
    return cut_at(events, closings(events))


def channel_of(job_id: Column) -> Column:
    """Name of the channel that carries a job's events."""
    return F.concat(F.lit("job:"), job_id.cast("string"), F.lit(":status"))


def subscribed(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """Events of the jobs asked for, with their channel."""
    return events.join(jobs.select("job_id"), "job_id", "left_semi").withColumn(
        "channel", channel_of(F.col("job_id"))
    )


def snapshot_then_tail(snapshots: DataFrame, events: DataFrame) -> DataFrame:
    """What a viewer of each job sees: its stored state as ``seq`` -1, then its events.

    A state may be seen twice, never missed. The stream of a job ends with its first terminal
    message; if the snapshot is terminal already, nothing follows.
    """
    first = snapshots.select("job_id", F.lit(-1).cast("bigint").alias("seq"), "status", "step")
    return terminal_cut(first.unionByName(events, allowMissingColumns=True))


def _as_changes(events: DataFrame) -> DataFrame:
    seq, status = F.col("seq"), F.col("status")
    return events.select(
        "job_id",
        "status",
        seq.alias("status_seq"),
        F.col("ts").alias("updated_at"),
        F.col("step").alias("current_step"),
        F.when(status == S.PROCESSING, seq).alias("step_seq"),
        _optional(events, "error").alias("error"),
        F.when(status == S.FAILED, seq).alias("error_seq"),
        _optional(events, "elapsed_ms").alias("elapsed_ms"),
        F.col("ts").alias("completed_at"),
        F.when(status == S.COMPLETED, seq).alias("completed_seq"),
    )


def merge_changes(changes: DataFrame) -> DataFrame:
    """One change row per job; merging merged rows again gives the same (it is associative)."""
    def last(value: str, by: str) -> Column:
        # In a struct, so that a null that was written is kept apart from no write.
        return F.max_by(F.struct(value), F.col(by))[value].alias(value)

    return changes.groupBy("job_id").agg(
        last("status", "status_seq"),
        F.max("status_seq").alias("status_seq"),
        last("updated_at", "status_seq"),
        last("current_step", "step_seq"),
        F.max("step_seq").alias("step_seq"),
        last("error", "error_seq"),
        F.max("error_seq").alias("error_seq"),
        last("elapsed_ms", "completed_seq"),
        last("completed_at", "completed_seq"),
        F.max("completed_seq").alias("completed_seq"),
    )


#: Columns of a change row.
CHANGE_COLUMNS = (
    "job_id", "status", "status_seq", "updated_at", "current_step", "step_seq", "error", "error_seq", "elapsed_ms",
    "completed_at", "completed_seq",
)


def job_changes(events: DataFrame) -> DataFrame:
    """What the events of each job do to its row, one row per job.

    ``events`` carries ``ts``. Progress writes the step, completion the elapsed time and the
    completion time, failure the error; each leaves the other columns as they were.
    """
    return merge_changes(_as_changes(events))


#: Which place tells whether a change wrote a column of a job row.
_WRITTEN_BY = {
    "status": "status_seq",
    "updated_at": "status_seq",
    "current_step": "step_seq",
    "error": "error_seq",
    "elapsed_ms": "completed_seq",
    "completed_at": "completed_seq",
}


def apply_changes(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Job rows after ``changes``. A change to an unknown job has no effect."""
    return _apply(jobs, changes, lambda seq: F.col(f"new_{seq}").isNotNull())


def apply_newer(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """The same for rows that carry the places of what wrote them: of each column the later write stays."""
    later = lambda seq: F.col(f"new_{seq}").isNotNull() & (F.col(seq).isNull() | (F.col(f"new_{seq}") > F.col(seq)))
    return _apply(rows, changes, later)


def _apply(rows: DataFrame, changes: DataFrame, written: Callable[[str], Column]) -> DataFrame:
    c = changes.select(F.col("job_id"), *[F.col(n).alias(f"new_{n}") for n in changes.columns if n != "job_id"])
    by = _WRITTEN_BY | {seq: seq for seq in set(_WRITTEN_BY.values())}
    return rows.join(c, "job_id", "left").select(
        *[F.when(written(by[n]), F.col(f"new_{n}")).otherwise(F.col(n)).alias(n) if n in by else n for n in rows.columns]
    )


def upsert_jobs(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """S8 in one go: last write wins per job and column."""
    return apply_changes(jobs, job_changes(events))


def step_elapsed(events: DataFrame) -> DataFrame:
    """Seconds from the first running entry of a step to its last closing entry."""
    stamped = events.withColumn("at", epoch_micros(events, "ts")).filter(
        _filled(F.col("step_status")).isNotNull()
    )
    running = F.col("step_status") == "running"
    return (
        stamped.groupBy("job_id", "step")
        .agg(
            F.min(F.when(running, F.col("at"))).alias("began"),
            F.max(F.when(~running, F.col("at"))).alias("ended"),
        )
        .select(
            "job_id", "step", seconds_between(F.col("began"), F.col("ended")).alias("elapsed_s")
        )
    )


def job_elapsed(events: DataFrame) -> DataFrame:
    """Milliseconds and seconds from a job's first processing event to its first terminal one.

    Null where a job has not ended, or ended before it was processed.
    """
    stamped = events.withColumn("at", F.floor(epoch_micros(events, "ts") / 1000))
    began = F.min(F.when(F.col("status") == S.PROCESSING, F.col("at")))
    ended = F.min(F.when(is_terminal(F.col("status")), F.col("at")))
    ms = F.when(F.col("ended") >= F.col("began"), F.col("ended") - F.col("began"))
    return (
        stamped.groupBy("job_id")
        .agg(began.alias("began"), ended.alias("ended"))
        .select(
            "job_id",
            ms.cast("bigint").alias("elapsed_ms"),
            round_binary(ms / 1000, 2).alias("elapsed_s"),
        )
    )


def step_matrix(events: DataFrame) -> DataFrame:
    """Five rows per job, the last entry of each labelled step or its default.

    One aggregation with a fixed number of columns, then a narrow explode: no join to a label
    table. Steps outside the five labels do not show.
    """
    listed = _filled(F.col("step_status")).isNotNull()
    entry = F.struct("step_status", F.coalesce(_optional(events, "detail"), F.lit("")).alias("detail"))
    latest = events.groupBy("job_id").agg(
        *[
            F.max_by(entry, F.when(listed & (F.col("step") == label), F.col("seq"))).alias(f"s{i}")
            for i, label in enumerate(S.STEP_LABELS)
        ]
    )

    def cell(i: int, label: str) -> Column:
        status, detail = step_default(label)
        found = F.col(f"s{i}")
        return F.struct(
            F.lit(i + 1).alias("label_no"),
            F.lit(label).alias("label"),
            F.coalesce(found["step_status"], F.lit(status)).alias("step_status"),
            F.when(found.isNull(), detail).otherwise(found["detail"]).alias("detail"),
        )

    cells = F.array(*[cell(i, label) for i, label in enumerate(S.STEP_LABELS)])
    return latest.select("job_id", F.inline(cells))
