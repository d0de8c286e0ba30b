"""State of jobs, for streams that need more than an aggregation.

Each class is handed to ``transformWithState``. :class:`UntilClosed` has a group and a state for each job. The others
have groups of many jobs and one state for a group, since PySpark asks for each key, state and timer of a group in a
call of its own, which for jobs of a few events costs far more than their rows. A group's rows of a micro-batch come
as an iterator; some of them are put in order before they are judged, the rest as they come, so a task never holds all
rows of a busy job. Every state ends by a timer in event time.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom import schemas as S

#: Rows of a job and micro-batch that are put in order, and those of a group of jobs.
BUFFER = 1000
GROUP_BUFFER = 20_000
#: ``seq`` of a snapshot: before all events.
SNAPSHOT_SEQ = -1

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep stream state in RocksDB, the only store with timers, unless the session has chosen it itself. Set once for the session: queries take the setting when they start."""
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKSDB)


def _in_order(rows: Iterator[Row], buffer: int = BUFFER) -> Iterator[Row]:
    yield from sorted(itertools.islice(rows, buffer), key=lambda r: r.seq)
    yield from rows


class UntilClosed(StatefulProcessor):
    """E5: a job's events up to its first terminal one. The state is the place of the event that closed it, for
    ``keep_ms`` of event time behind that event; a timer ends it."""

    def __init__(self, columns: list[str], keep_ms: int):
        self.columns, self.keep_ms = columns, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.row = handle, Row(*self.columns)
        self.closed = handle.getValueState("closed", "closed_at long, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        closed_at, due = self.closed.get() or (None, None)
        before = closed_at
        for row in _in_order(rows):
            if closed_at is None or row.seq <= closed_at:
                if row.status in S.TERMINAL:
                    closed_at = row.seq
                    if due is None:
                        due = max(row.at_ms, timerValues.getCurrentWatermarkInMs()) + self.keep_ms
                        self.handle.registerTimer(due)
                if row.is_own:
                    yield self.row(*[row[c] for c in self.columns])
        if closed_at != before:
            self.closed.update((closed_at, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.closed.clear()
        return iter(())

    def close(self) -> None:
        pass


class _JobGroup(StatefulProcessor):
    """Many jobs in one state: a JSON list for each, with its id first, and the one timer of the group, which stands
    where the first of them falls due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("jobs", "jobs string, timer long")

    def _load(self) -> tuple[dict[str | None, list], int | None]:
        jobs, timer = self.held.get() or ("[]", None)
        return {job_id: values for job_id, *values in json.loads(jobs)}, timer

    def _store(self, jobs: dict[str | None, list], dues: Iterable[int | None], timer: int | None) -> None:
        """``timer`` is the one that stands and has not expired."""
        due = min((d for d in dues if d is not None), default=None)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if jobs:
            self.held.update((json.dumps([[job_id, *values] for job_id, values in jobs.items()]), due))
        else:
            self.held.clear()

    def close(self) -> None:
        pass


class GroupUntilClosed(_JobGroup):
    """The events of a group's jobs up to the first terminal message of each; before them, a job's stored
    state if it has one.

    Of a job the state holds its snapshot until that is sent, then the place of what closed it for ``keep_ms`` of event
    time. A job without events has its snapshot sent by a timer, as soon as the stream's clock moves.
    """

    def __init__(self, columns: list[str], keep_ms: int, salted: bool = False):
        self.columns, self.keep_ms, self.salted = columns, keep_ms, salted

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.row = Row(*self.columns)

    # A job's values: place and due time of its closing, then status and step of a snapshot not yet sent.

    def _save(self, jobs: dict[str | None, list], timer: int | None) -> None:
        self._store(jobs, (1 if len(v) > 2 else v[1] for v in jobs.values()), timer)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        shots = {s["job_id"]: [None, None, s["status"], s["step"]] for s in initialState.snapshots}
        self._save(shots, None)

    def _first(self, job_id: str | None, jobs: dict[str | None, list], watermark: int) -> Iterator[Row]:
        _, _, status, step = jobs.pop(job_id)
        values = {"job_id": job_id, "seq": SNAPSHOT_SEQ, "status": status, "step": step}
        yield self.row(*[values.get(c) for c in self.columns])
        if status in S.TERMINAL:
            jobs[job_id] = [SNAPSHOT_SEQ, max(0, watermark) + self.keep_ms]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        jobs, timer = self._load()
        watermark, changed = timerValues.getCurrentWatermarkInMs(), False
        for row in _in_order(rows, GROUP_BUFFER):
            job_id = row.job_id
            found = jobs.get(job_id)
            if found and len(found) > 2:
                yield from self._first(job_id, jobs, watermark)
                found, changed = jobs.get(job_id), True
            if found is None or row.seq <= found[0]:
                if row.status in S.TERMINAL and (found is None or row.seq < found[0]):
                    due = found[1] if found else max(row.at_ms, watermark) + self.keep_ms
                    jobs[job_id], changed = [row.seq, due], True
                if not self.salted or row.is_own:
                    yield self.row(*row[: len(self.columns)])
        if changed:
            self._save(jobs, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        jobs, _ = self._load()
        watermark = timerValues.getCurrentWatermarkInMs()
        for job_id in [j for j, v in jobs.items() if len(v) > 2]:
            yield from self._first(job_id, jobs, watermark)
        for job_id, (_, due) in list(jobs.items()):
            if due <= watermark:
                # a snapshot that closed a job before the clock had moved stays for its time from then on
                if due <= self.keep_ms:
                    jobs[job_id][1] = watermark + self.keep_ms
                else:
                    del jobs[job_id]
        self._save(jobs, None)


#: What :class:`Silence` tells.
TOLD = Row("job_id", "status", "seq", "last_at", "stuck")


class Silence(_JobGroup):
    """A job that has been silent for a time, told once, and told again when it goes on.

    Of a job the state holds its newest event, whether it has ended, whether its silence has been told, and the event
    time at which its silence gets too long; for a job that has ended that ends its part of the state.
    """

    def __init__(self, cutoff_ms: int, delay_ms: int):
        # the watermark is ``delay`` behind the newest event, so the time stands as much earlier
        self.wait_ms = cutoff_ms - delay_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        jobs, timer = self._load()
        touched: dict[str | None, bool] = {}  # whether a job has a newer event
        for row in rows:
            job_id = row.job_id
            seq, status, at, ended, told, due = jobs.get(job_id) or (None, None, None, False, False, None)
            touched[job_id] = touched.get(job_id, False) or at is None or row.at_us > at
            if seq is None or row.seq > seq:
                seq, status = row.seq, row.status
            at = row.at_us if at is None else max(at, row.at_us)
            jobs[job_id] = [seq, status, at, ended or row.status in S.TERMINAL, told, due]
        for job_id, newer in touched.items():
            seq, status, at, ended, told, _ = jobs[job_id]
            if told and (newer or ended):
                told = False
                yield TOLD(job_id, status, seq, at, False)
            jobs[job_id][4:] = told, at // 1000 + self.wait_ms - 1
        self._store(jobs, (v[5] for v in jobs.values()), timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        jobs, _ = self._load()
        watermark = timerValues.getCurrentWatermarkInMs()
        for job_id, (seq, status, at, ended, told, due) in list(jobs.items()):
            if due is None or due > watermark:
                continue
            if ended:
                del jobs[job_id]
                continue
            # a job told before that got late events only has them on record, and is not told again
            jobs[job_id][4:] = True, None
            if not told:
                yield TOLD(job_id, status, seq, at, True)
        self._store(jobs, (v[5] for v in jobs.values()), None)
