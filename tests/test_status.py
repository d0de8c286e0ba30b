"""Event folds against brute force, in batch and as streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docloom import schemas as S
from docloom.operators import jobs, status
from docloom.sources import files, sinks
from docloom.streaming import queries as streams
from tests.conftest import plan_of

SCHEMA = (
    "job_id string, seq bigint, ts timestamp, status string, step string, step_status string, "
    "detail string, elapsed_s double, elapsed_ms int, error string"
)


def random_events(n=1500, seed=5, hot=0.35):
    """Events of few jobs, one of which holds about a third of all rows."""
    import datetime as dt

    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        job = "hot" if rng.random() < hot else f"j{rng.randrange(120)}"
        state = rng.choices(["queued", "processing", "completed", "failed"], [1, 12, 1, 1])[0]
        step = rng.choice(["OCR", "Clean Text", "Qwen", "Validate JSON", "Other", None, ""]) if state == "processing" else None
        step_status = rng.choice(["running", "ok", "fallback", None]) if step else None
        rows.append(
            (
                job, seq, dt.datetime(2024, 3, 31) + dt.timedelta(milliseconds=7919 * seq), state, step, step_status,
                rng.choice([None, "d"]) if step_status else None, None,
                seq if state == "completed" else None,
                rng.choice([None, "", "E: x"]) if state == "failed" else None,
            )
        )
    return rows


EVENTS = random_events()


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(EVENTS, SCHEMA).repartition(8)


def by_job(rows=EVENTS):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def slow_states():
    out = {}
    for job, rows in by_job().items():
        state = {"status": None, "step": None, "error": None}
        for r in rows:
            state["status"] = r[3]
            state["step"] = r[4] or state["step"]
            if r[3] == "failed":
                state["error"] = r[9] or "Job failed"
        out[job] = (state["status"], state["step"], state["error"], rows[-1][1])
    return out


def slow_cut():
    kept = set()
    for job, rows in by_job().items():
        for r in rows:
            kept.add((job, r[1]))
            if r[3] in ("completed", "failed"):
                break
    return kept


def states(df):
    return {r.job_id: (r.status, r.step, r.error, r.last_seq) for r in df.collect()}


def test_current_state(events):
    assert states(status.current_state(events)) == slow_states()


def test_current_state_combines_before_its_one_shuffle(events):
    plan = plan_of(status.current_state(events), "simple")
    assert plan.count("Exchange hashpartitioning(job_id") == 1
    assert "partial_max_by" in plan and "Window" not in plan


def test_step_list(events):
    want = {}
    for job, rows in by_job().items():
        steps = {}
        for r in rows:
            if r[5]:
                steps[r[4]] = (r[5], r[6] or "")
        want.update({(job, i + 1): (s, *v) for i, (s, v) in enumerate(steps.items())})
    got = {(r.job_id, r.step_no): (r.step, r.step_status, r.detail) for r in status.step_list(events).collect()}
    assert got == want


def test_terminal_cut(events):
    got = {(r.job_id, r.seq) for r in status.terminal_cut(events).collect()}
    assert got == slow_cut()
    assert "Window" not in plan_of(status.terminal_cut(events))


def test_snapshot_then_tail(spark, events):
    table = spark.createDataFrame(
        [("hot", "processing", "OCR", None), ("j1", "completed", None, None)],
        "job_id string, status string, current_step string, error string",
    )
    mine = events.filter(F.col("job_id").isin("hot", "j1"))
    rows = status.snapshot_then_tail(jobs.snapshot(table), mine).orderBy("job_id", "seq").collect()
    hot = [r.seq for r in rows if r.job_id == "hot"]
    assert hot == [-1] + sorted(s for j, s in slow_cut() if j == "hot")
    assert [(r.seq, r.status, r.step) for r in rows if r.job_id == "j1"] == [(-1, "completed", "")]


def slow_job_rows():
    out = {}
    for job, rows in by_job().items():
        row = {"status": "queued", "step": None, "error": None, "ms": None, "done": None, "at": None}
        for r in rows:
            row["status"], row["at"] = r[3], r[2]
            if r[3] == "processing":
                row["step"] = r[4]
            elif r[3] == "completed":
                row["ms"], row["done"] = r[8], r[2]
            elif r[3] == "failed":
                row["error"] = r[9]
        out[job] = tuple(row.values())
    return out


def job_rows(spark):
    names = sorted(by_job()) + ["untouched"]
    return spark.createDataFrame([(n, "queued") for n in names], "job_id string, status string").select(
        "job_id", F.lit("f").alias("filename"), "status", F.lit(None).cast("string").alias("current_step"),
        F.lit(None).cast("string").alias("error"), F.lit(None).cast("int").alias("elapsed_ms"),
        F.lit(None).cast("timestamp").alias("updated_at"), F.lit(None).cast("timestamp").alias("completed_at"),
    )


def as_tuples(df):
    return {
        r.job_id: (r.status, r.current_step, r.error, r.elapsed_ms, r.completed_at, r.updated_at)
        for r in df.collect()
    }


def want_rows():
    return {**slow_job_rows(), "untouched": ("queued", None, None, None, None, None)}


def test_upsert(spark, events):
    table = job_rows(spark)
    stranger = events.limit(1).withColumn("job_id", F.lit("stranger"))
    got = status.upsert_jobs(table, events.unionByName(stranger))
    assert got.columns == table.columns
    assert as_tuples(got) == want_rows()


def test_changes_merge_in_any_split(spark, events):
    parts = [status.job_changes(events.filter(F.col("seq") % 3 == i)) for i in (2, 0, 1)]
    merged = status.merge_changes(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert as_tuples(status.apply_changes(job_rows(spark), merged)) == want_rows()


def test_step_and_job_times(events):
    want_steps, want_jobs = {}, {}
    for job, rows in by_job().items():
        spans = {}
        for r in rows:
            if r[5]:
                spans.setdefault(r[4], ([], []))[r[5] != "running"].append(r[2])
        for step, (began, ended) in spans.items():
            if began and ended:
                want_steps[job, step] = round((max(ended) - min(began)).total_seconds(), 2)
            else:
                want_steps[job, step] = None
        began = [r[2] for r in rows if r[3] == "processing"]
        ended = [r[2] for r in rows if r[3] in ("completed", "failed")]
        ms = None
        if began and ended and min(ended) >= min(began):
            ms = round((min(ended) - min(began)).total_seconds() * 1000)
        want_jobs[job] = (ms, None if ms is None else round(ms / 1000, 2))
    assert {(r.job_id, r.step): r.elapsed_s for r in status.step_elapsed(events).collect()} == want_steps
    got = {r.job_id: (r.elapsed_ms, r.elapsed_s) for r in status.job_elapsed(events).collect()}
    assert got == want_jobs


def test_times_do_not_depend_on_the_zone_or_type(spark, events):
    want = {r.job_id: r.elapsed_ms for r in status.job_elapsed(events).collect()}
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        zoned = {r.job_id: r.elapsed_ms for r in status.job_elapsed(events).collect()}
        naive = spark.createDataFrame(EVENTS, SCHEMA.replace("ts timestamp", "ts timestamp_ntz"))
        unzoned = {r.job_id: r.elapsed_ms for r in status.job_elapsed(naive).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    seconds = events.withColumn("ts", F.unix_micros("ts") / 1e6)
    epoch = {r.job_id: r.elapsed_ms for r in status.job_elapsed(seconds).collect()}
    assert zoned == want == unzoned == epoch


def test_step_matrix(events):
    got = {}
    for r in status.step_matrix(events).collect():
        got.setdefault(r.job_id, {})[r.label] = (r.step_status, r.detail)
    assert set(got) == set(by_job())
    for job, rows in by_job().items():
        last = {r[4]: (r[5], r[6] or "") for r in rows if r[5]}
        for label in S.STEP_LABELS:
            default = ("ok", "tersimpan") if label == "Database" else ("skip", "dilewati")
            assert got[job][label] == last.get(label, default)


def test_subscriptions(spark, events):
    asked = spark.createDataFrame([("j1",), ("nobody",)], "job_id string")
    rows = status.subscribed(events, asked).collect()
    assert {r.seq for r in rows} == {r[1] for r in EVENTS if r[0] == "j1"}
    assert {r.channel for r in rows} == {"job:j1:status"}


GOOD = {"job_id": "a", "status": "processing", "step": "OCR", "timestamp": 1.5}
MESSAGES = [
    (json.dumps(GOOD), True),
    ("  " + json.dumps(GOOD) + " \n", True),
    (json.dumps(GOOD)[:-1], False),
    (json.dumps(GOOD) + " x", False),
    (json.dumps(GOOD) + "}", False),
    (json.dumps(GOOD) + "}}", False),
    (json.dumps(GOOD) + "]", False),
    (json.dumps(GOOD) + ", 1", False),
    ("{'job_id': 'a'}", False),
    ("", False),
    ("null", False),
    ("not json", False),
    ('{"job_id": "a", "status": "x", "elapsed_ms": "soon"}', True),
    ('{"job_id": "a", "status": NaN}', False),
    ('{"job_id": "b", "status": "failed", "job_id": "a", "new": {"x": [1]}}', True),
]


def test_malformed_messages_are_dropped(spark):
    rows = [(i, m) for i, (m, _) in enumerate(MESSAGES)]
    got = status.parse_events(spark.createDataFrame(rows, "i int, value string")).collect()
    assert sorted(r.i for r in got) == [i for i, (_, good) in enumerate(MESSAGES) if good]
    assert {r.job_id for r in got} == {"a"}
    assert [r.timestamp for r in got if r.i == 0] == [1.5]


# ---- streams ---------------------------------------------------------------------------------


def landed(spark, events, path, **options):
    sinks.append(events.repartitionByRange(5, "seq"), path)
    return files.event_stream(spark, path, files_per_trigger=1, schema=events.schema, **options)


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_stream_state_equals_batch(spark, events, tmp_path):
    stream = landed(spark, events, str(tmp_path / "in"))
    run(streams.follow_state(stream, str(tmp_path / "out"), str(tmp_path / "cp")))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.select("batch_id").distinct().count() > 1
    assert states(sinks.latest_states(written)) == slow_states()
    sinks.compact(spark, str(tmp_path / "out"), str(tmp_path / "compacted"))
    assert states(sinks.latest_states(spark.read.parquet(str(tmp_path / "compacted")))) == slow_states()


def test_states_and_cut_survive_a_lost_checkpoint(spark, events, tmp_path):
    """Three batches, then the checkpoint is lost, one more event lands, and all is one batch."""
    path, out, passed = (str(tmp_path / n) for n in ("in", "out", "passed"))
    first = events.filter("seq < 900")
    for n, stream in enumerate((landed(spark, first, path), landed(spark, events.filter("seq >= 900"), path))):
        if n:
            stream = files.event_stream(spark, path, schema=events.schema)
        run(streams.follow_state(stream, out, str(tmp_path / f"cp-a{n}")))
        run(streams.follow_until_closed(stream, passed, str(tmp_path / f"cp-b{n}")))
    assert states(sinks.latest_states(spark.read.parquet(out))) == slow_states()
    got = streams.read_until_closed(spark.read.parquet(passed))
    assert sorted((r.job_id, r.seq) for r in got.collect()) == sorted(slow_cut())


def test_stream_goes_on_after_a_restart(spark, events, tmp_path):
    """Files that land after the query ended are read by the next run, the others are not."""
    path, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for half in (events.filter("seq < 700"), events.filter("seq >= 700")):
        run(streams.follow_changes(landed(spark, half, path), out, cp))
    changes = spark.read.parquet(out)
    assert changes.select(F.max("batch_id")).first()[0] == 9
    merged = status.merge_changes(changes.drop("generation", "batch_id"))
    assert as_tuples(status.apply_changes(job_rows(spark), merged)) == want_rows()


def test_replay_changes_nothing(spark, events, tmp_path):
    stream = landed(spark, events, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for attempt in range(2):
        run(streams.follow_changes(stream, out, str(tmp_path / f"cp{attempt}")))
    merged = status.merge_changes(spark.read.parquet(out).drop("generation", "batch_id"))
    assert as_tuples(status.apply_changes(job_rows(spark), merged)) == want_rows()


def test_event_json_round_trip(spark, events, tmp_path):
    sinks.append_event_json(events.drop("ts"), str(tmp_path / "json"))
    lines = spark.read.text(str(tmp_path / "json"))
    assert status.parse_events(lines).count() == len(EVENTS)
