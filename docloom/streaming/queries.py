"""The batch steps as streaming queries.

Each function starts a query and returns it. State that must outlive an executor is in the query's
checkpoint or in written batches; nothing is cached.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.functions.times import epoch_micros
from docloom.operators import admission, results, status
from docloom.sources import sinks
from docloom.sources.job_table import JobTable
from docloom.sources.keyed import KeyedTable
from docloom.streaming import processors

#: Groups that hold the states of jobs. A batch moves the states of all groups it touches.
JOB_GROUPS = 1024

_UNITS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def _start(
    stream: DataFrame,
    write: Callable[[DataFrame, int, int], None],
    checkpoint: str,
    once: bool,
    mode: str = "append",
) -> StreamingQuery:
    """``write`` gets each batch with its number and the generation of the checkpoint."""
    generation = sinks.generation_of(stream.sparkSession, checkpoint)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(lambda batch, batch_id: write(batch, batch_id, generation)).start()


def _near(table: DataFrame | KeyedTable, keys: DataFrame) -> DataFrame:
    """Rows of a static table whose key stands in the one column of ``keys``, and maybe others that a join drops."""
    if isinstance(table, KeyedTable):
        return table.near(keys)
    return table.join(keys, keys.columns[0], "left_semi")


def run_jobs(
    messages: DataFrame,
    converted: DataFrame | KeyedTable,
    responses: DataFrame | KeyedTable,
    out: str,
    checkpoint: str,
    events_out: str | None = None,
    once: bool = True,
    changes_out: str | None = None,
) -> StreamingQuery:
    """Queued jobs to result records, a micro-batch at a time.

    ``converted(file_key, doc_id, text, tables, confidence)``, keyed by ``file_key``, and ``responses``,
    keyed by ``doc_id``, are static tables. Written by :func:`docloom.sources.keyed.save_keyed`, a batch
    opens only the folders its own keys hash to; of other tables it takes the rows of its own keys, which
    scans them whole in every batch. Nothing is parsed before. ``converted`` may carry ``error_type`` and ``error_message``: a document that has them could not be converted, and
    its job fails with both (R6) while all others finish. With ``events_out``, also the status events
    (E2): 18 for each job with a result, start and failure for each job whose object is missing (S6)
    or broken. They are made from the stored results, so nothing is computed twice. Their times are
    those of the batch: its start, the storing of its results (on the last step), its end.
    :func:`ordered` puts them in order over batches, for :func:`follow_changes`. With ``changes_out`` each batch
    also folds its own stored events (S8); :func:`latest_changes` reads that.

    Answers are joined to the narrow keys of the batch before any text is read, so a text is shuffled once at
    most, before it is cleaned, and a result never. The narrow part of the batch's own documents, with their errors,
    is read once and kept for the batch beside its jobs: answers, losses and failures all come from that.
    """

    def write(batch: DataFrame, batch_id: int, generation: int) -> None:
        began = time.time()
        # A job queued twice in one batch is done once. Kept for the batch by its files, which all steps join by.
        jobs = admission.default_names(batch).dropDuplicates(["job_id"]).repartition("file_key").persist()
        held = None
        try:
            near = _near(converted, jobs.select("file_key"))
            narrow = ("file_key", "doc_id", "error_type", "error_message")
            own = near.select(*[c for c in narrow if c in near.columns])
            held = own.join(jobs.select("file_key").distinct(), "file_key", "left_semi").persist()
            run(jobs, near, held, batch_id, generation, began)
        finally:
            jobs.unpersist()
            if held is not None:
                held.unpersist()

    def run(jobs: DataFrame, near: DataFrame, held: DataFrame, batch_id: int, generation: int, began: float) -> None:
        broken = F.col("error_type").isNotNull() if "error_type" in near.columns else F.lit(False)
        readable = near.filter(~broken).drop("error_type", "error_message")
        ids = held.filter(~broken).select("file_key", "doc_id")
        answered = _with_answers(jobs.join(readable, "file_key"), ids, responses)
        records = results.build_answered(answered)
        timed = records.withColumn("elapsed_s", F.round(F.lit(time.time() - began), 2))
        sinks.save_batch(timed, out, batch_id, generation)
        if events_out is None:
            return
        stored = jobs.sparkSession.read.parquet(sinks.batch_folder(out, generation, batch_id))
        ended = time.time()
        times = {
            "elapsed_ms": F.lit(int((ended - began) * 1000)),
            "started_at": F.lit(began),
            "stored_at": F.lit(ended),
            "ended_at": F.lit(time.time()),
        }
        done = results.emit_events(stored.withColumns(times))
        lost = admission.attach_files(jobs.join(held, "file_key", "left_anti"), held.select("file_key").limit(0))
        failed = lost.select("job_id", "error")
        if "error_type" in held.columns:
            said = results.error_text(F.col("error_type"), F.col("error_message")).alias("error")
            failed = failed.unionByName(jobs.join(held.filter(broken), "file_key").select("job_id", said))
        events = done.unionByName(results.emit_failures(failed.withColumns(times)))
        stamped = events.withColumn("ts", F.timestamp_micros((F.col("timestamp") * 1_000_000).cast("bigint")))
        sinks.save_batch(stamped, events_out, batch_id, generation)
        if changes_out is not None:
            told = jobs.sparkSession.read.parquet(sinks.batch_folder(events_out, generation, batch_id))
            sinks.save_batch(status.job_changes(told), changes_out, batch_id, generation)

    return _start(messages, write, checkpoint, once)


def _with_answers(docs: DataFrame, ids: DataFrame, responses: DataFrame | KeyedTable) -> DataFrame:
    """``docs`` with the ``response`` of each, as a left join by ``doc_id`` gives them, but without a shuffle by
    it: the answers of a ``file_key`` come to its rows, which are together already."""
    answers = _near(responses, ids.select("doc_id")).select("doc_id", "response")
    entry = F.struct("doc_id", "response")
    told = ids.distinct().join(answers, "doc_id").groupBy("file_key").agg(F.collect_list(entry).alias("told"))
    own = F.filter("told", lambda x: x["doc_id"] == F.col("doc_id"))
    given = docs.join(told, "file_key", "left").withColumn("answer", F.explode_outer(own))
    return given.withColumn("response", F.col("answer.response")).drop("told", "answer")


def latest_changes(changes: DataFrame) -> DataFrame:
    """Of the changes that :func:`run_jobs` wrote, those of the last batch that ran each job; one row a job."""
    row = F.struct(*status.CHANGE_COLUMNS)
    last = changes.groupBy("job_id").agg(F.max_by(row, F.struct("generation", "batch_id")).alias("row"))
    return last.select("row.*")


def ordered(events: DataFrame) -> DataFrame:
    """Events of :func:`run_jobs` as read back, in an order over generations and batches: ``seq``
    becomes a struct that rises in it. Of a job that several generations ran, the last one's stay."""
    rows = sinks.latest_per_job(events)
    return rows.withColumn("seq", F.struct("generation", "batch_id", "seq")).drop("generation", "batch_id")


def follow_state(
    events: DataFrame,
    out: str,
    checkpoint: str,
    once: bool = True,
    delay: str = "1 day",
    window: str = "7 days",
) -> StreamingQuery:
    """E3 as a stateful aggregation whose state ends: each batch writes the folds that changed.

    ``events`` carries ``ts``. An event that comes again within ``delay`` is counted once. Folds are kept by job
    and ``window`` of time; when the watermark, ``delay`` behind the newest event, has passed a window, its
    folds leave the state, and events older than that are dropped as late. All of it is done by Spark's own
    operators, which combine before they shuffle. Read with :func:`sinks.latest_states`, which merges a job's
    windows; :func:`sinks.compact` folds old batches into one.
    """
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    once_each = timed.dropDuplicatesWithinWatermark(["job_id", "seq"])
    return _start(
        status.current_fold(once_each, F.window("at", window).alias("span")),
        lambda batch, batch_id, generation: sinks.save_batch(
            batch.withColumn("span", F.col("span.start")), out, batch_id, generation
        ),
        checkpoint,
        once,
        mode="update",
    )


def follow_changes(
    events: DataFrame, out: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Each batch writes one change row per job it touched; no state is kept.

    Read with :func:`sinks.read_batches`, then :func:`status.merge_changes` and
    :func:`status.apply_changes`.
    """
    return _start(
        events,
        lambda batch, batch_id, generation: sinks.save_batch(status.job_changes(batch), out, batch_id, generation),
        checkpoint,
        once,
    )


def follow_into_table(
    events: DataFrame, table: JobTable, checkpoint: str, once: bool = True, fold_every: int = 10
) -> StreamingQuery:
    """Each batch adds its changes to a job table, and every ``fold_every`` batches they are folded in. Run
    one stream for a table, since folds replace files."""

    def write(batch: DataFrame, batch_id: int, generation: int) -> None:
        table.add(status.job_changes(batch), batch_id, generation)
        if (batch_id + 1) % fold_every == 0:
            table.fold(batch.sparkSession)

    return _start(events, write, checkpoint, once)


def follow_until_closed(
    events: DataFrame,
    out: str,
    checkpoint: str,
    once: bool = True,
    delay: str = "1 day",
    keep: str = "7 days",
    salts: int = 1,
    groups: int | None = None,
) -> StreamingQuery:
    """E5: pass events on until their job's first terminal event.

    ``events`` carries ``ts``. The state holds one number for each closed job and forgets it ``keep`` after the
    closing, so a batch's work follows its own events. Events that are ``delay`` older than the newest are dropped
    as late. With ``salts`` above one, the events of a job are dealt over as many groups and each terminal event
    is shown to all of them, for streams in which one job may hold a large part of all events. With ``groups`` the
    jobs are dealt over as many groups that hold one state each, for batches with many jobs of few events: a batch
    reads and writes the states of its groups whole, but has no calls to the state store for each job. Batches may
    bring events out of order: :func:`read_until_closed` cuts what was passed on once more.
    """
    own = F.pmod(F.xxhash64("seq"), F.lit(salts)).cast("int")
    shown = F.when(status.is_terminal(F.col("status")), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(own))
    if salts > 1:
        dealt = events.withColumn("salt", F.explode(shown)).withColumn("is_own", F.col("salt") == own)
    elif groups is None:
        dealt = events.withColumns({"salt": F.lit(0), "is_own": F.lit(True)})
    else:
        dealt = events  # each column more costs time for every row
    timed = _timed(dealt, delay)
    if groups is None:
        keyed, processor = timed.groupBy("job_id", "salt"), processors.UntilClosed(events.columns, milliseconds(keep))
    else:
        keyed = _grouped(timed, groups).groupBy("job_group", *["salt"] * (salts > 1))
        processor = processors.GroupUntilClosed(events.columns, milliseconds(keep), salts > 1)
    passed = keyed.transformWithState(processor, events.schema, "append", "eventTime")
    return _start(passed, _saved_to(out), checkpoint, once)


def _grouped(rows: DataFrame, groups: int) -> DataFrame:
    """``rows`` with the ``job_group`` that their job is dealt to."""
    return rows.withColumn("job_group", F.pmod(F.xxhash64("job_id"), F.lit(groups)).cast("int"))


def _timed(events: DataFrame, delay: str) -> DataFrame:
    """Events with their time as ``at`` under a watermark and as ``at_ms``, for a state that ends."""
    processors.use_rocksdb(events.sparkSession)
    at = epoch_micros(events, "ts")
    timed = events.withColumns({"at": F.timestamp_micros(at), "at_ms": F.floor(at / 1000).cast("bigint")})
    return timed.withWatermark("at", delay)


def _saved_to(out: str) -> Callable[[DataFrame, int, int], None]:
    return lambda batch, batch_id, generation: sinks.save_batch(batch, out, batch_id, generation)


def milliseconds(interval: str) -> int:
    """Milliseconds of an interval like ``7 days``, ``90 minutes`` or ``1 hour 30 seconds``."""
    words = interval.split()
    if not words or len(words) % 2:
        raise ValueError(f"no interval: {interval}")
    return sum(int(float(n) * _UNITS[unit.rstrip("s")]) for n, unit in zip(words[::2], words[1::2], strict=True))


def read_until_closed(passed: DataFrame) -> DataFrame:
    """E5: what :func:`follow_until_closed` passed on, once each, cut at the closings known by now. An event
    that closes a job earlier than was known is always passed on, so the events themselves tell."""
    once = passed.drop("generation", "batch_id").dropDuplicates(["job_id", "seq"])
    return status.terminal_cut(once)


def follow_snapshot_tail(
    snapshots: DataFrame,
    events: DataFrame,
    out: str,
    checkpoint: str,
    once: bool = True,
    delay: str = "1 day",
    keep: str = "7 days",
    groups: int = JOB_GROUPS,
) -> StreamingQuery:
    """What the viewers of all jobs see: each job's stored state, then its events until it ends.

    ``snapshots(job_id, status, step)`` has a row for each job and is read when the stream first starts, after
    the events are subscribed to; so a state may be older than the first event and seen twice, never missed. It
    becomes the first state of the stream and is sent before a job's first event, or by a timer if there is
    none. A job without a snapshot has its events only. ``delay``, ``keep`` and ``groups`` as in
    :func:`follow_until_closed`.
    Read with :func:`read_snapshot_tail`.
    """
    timed = _grouped(_timed(events, delay), groups)
    shot = F.struct("job_id", "status", "step")
    shots = _grouped(snapshots, groups).groupBy("job_group").agg(F.collect_list(shot).alias("snapshots"))
    tail = timed.groupBy("job_group").transformWithState(
        processors.GroupUntilClosed(events.columns, milliseconds(keep)),
        events.schema,
        "append",
        "eventTime",
        initialState=shots.groupBy("job_group"),
    )
    return _start(tail, _saved_to(out), checkpoint, once)


def read_snapshot_tail(seen: DataFrame) -> DataFrame:
    """What :func:`follow_snapshot_tail` sent, once each, cut at the first terminal message of each job."""
    return read_until_closed(seen)


def follow_silence(
    events: DataFrame,
    out: str,
    checkpoint: str,
    cutoff_seconds: int,
    once: bool = True,
    delay: str = "1 hour",
    groups: int = JOB_GROUPS,
) -> StreamingQuery:
    """X4 while it happens: a row for each job that falls silent for ``cutoff_seconds`` before it has ended, and
    one when it goes on. ``events`` carries ``ts`` and may come late by ``delay``, no more than the cutoff.

    The state of an ended job goes ``cutoff_seconds`` after its newest event. ``groups`` as in
    :func:`follow_until_closed`. Read with :func:`read_silence`.
    """
    delay_ms = milliseconds(delay)
    if delay_ms > cutoff_seconds * 1000:
        raise ValueError("the delay must not exceed the cutoff")
    timed = _timed(events, delay).select("job_id", "seq", "status", "at", epoch_micros(events, "ts").alias("at_us"))
    told = _grouped(timed, groups).groupBy("job_group").transformWithState(
        processors.Silence(cutoff_seconds * 1000, delay_ms),
        "job_id string, status string, seq long, last_at long, stuck boolean",
        "append",
        "eventTime",
    )
    return _start(told, _saved_to(out), checkpoint, once)


def read_silence(told: DataFrame, cutoff_seconds: int, now: Column) -> DataFrame:
    """The jobs that are silent as of ``now`` (epoch microseconds), as ``reports.stuck_jobs`` gives them."""
    last = told.groupBy("job_id").agg(
        F.max_by(F.struct("status", "last_at", "stuck"), F.struct("last_at", "seq", "stuck")).alias("last")
    )
    idle = now - F.col("last.last_at")
    return last.filter(F.col("last.stuck") & (idle >= cutoff_seconds * 1_000_000)).select(
        "job_id", "last.status", F.floor(idle / 1_000_000).cast("bigint").alias("idle_s")
    )
