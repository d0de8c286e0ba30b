"""Streams with state of one job, the tables that streams look up, and the job table."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from docloom.operators import reports, status
from docloom.sources import files, keyed, sinks
from docloom.sources.job_table import JobTable
from docloom.streaming import queries as streams
from tests.conftest import plan_of
from tests.test_status import EVENTS, SCHEMA, as_tuples, by_job, job_rows, landed, run, slow_cut, slow_states, states, want_rows


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(EVENTS, SCHEMA).repartition(8)


# ---- E5 --------------------------------------------------------------------------------------


@pytest.mark.parametrize("salts", [1, 3])
def test_stream_cut_equals_batch(spark, events, tmp_path, salts):
    stream = landed(spark, events, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    run(streams.follow_until_closed(stream, out, str(tmp_path / "cp"), salts=salts))
    passed = spark.read.parquet(out)
    got = streams.read_until_closed(passed)
    assert sorted((r.job_id, r.seq) for r in got.collect()) == sorted(slow_cut())
    assert got.columns == events.columns
    # what came after a closing of an earlier batch was not even passed on
    assert passed.count() < 0.8 * len(EVENTS)


def test_cut_state_is_one_row_a_closed_job(spark, events, tmp_path):
    stream = landed(spark, events, str(tmp_path / "in"))
    query = streams.follow_until_closed(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    run(query)
    closed = {r[0] for r in EVENTS if r[3] in ("completed", "failed")}
    rows = spark.read.format("statestore").option("stateVarName", "closed").load(str(tmp_path / "cp"))
    assert rows.count() == len(closed)
    least = {r.key.job_id: r.value.closed_at for r in rows.collect()}
    assert least == {j: min(r[1] for r in EVENTS if r[0] == j and r[3] in ("completed", "failed")) for j in closed}


def test_a_closing_that_comes_late_cuts_what_was_passed(spark, events, tmp_path):
    """Batches from the last events to the first."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for least in (1200, 800, 400, 0):
        sinks.append(events.filter((F.col("seq") >= least) & (F.col("seq") < least + 400)).coalesce(1), path)
        run(streams.follow_until_closed(files.event_stream(spark, path, schema=events.schema), out, str(tmp_path / "cp")))
    got = streams.read_until_closed(spark.read.parquet(out))
    assert {(r.job_id, r.seq) for r in got.collect()} == slow_cut()


def groups_held(spark, checkpoint):
    """The jobs in the states of groups."""
    rows = spark.read.format("statestore").option("stateVarName", "jobs").load(checkpoint).collect()
    return [json.loads(r.value.jobs) for r in rows]


@pytest.mark.parametrize("salts", [1, 3])
def test_groups_of_jobs_pass_on_what_single_jobs_do(spark, events, tmp_path, salts):
    """Batches out of order, two files each; a group has one state, however many jobs it holds."""
    path, alone, grouped = (str(tmp_path / n) for n in ("in", "alone", "grouped"))
    for least in (800, 0, 1200, 400):
        sinks.append(events.filter((F.col("seq") >= least) & (F.col("seq") < least + 400)).repartition(2), path)
        for out, groups in ((alone, None), (grouped, 3)):
            stream = files.event_stream(spark, path, schema=events.schema)
            run(streams.follow_until_closed(stream, out, f"{out}-cp", salts=salts, groups=groups))
    one, many = (sorted(spark.read.parquet(o).drop("generation").collect(), key=str) for o in (alone, grouped))
    assert [tuple(r) for r in one] == [tuple(r) for r in many]
    got = streams.read_until_closed(spark.read.parquet(grouped))
    assert {(r.job_id, r.seq) for r in got.collect()} == slow_cut()
    held = groups_held(spark, f"{grouped}-cp")
    closed = {r[0] for r in EVENTS if r[3] in ("completed", "failed")}
    assert len(held) <= 3 * salts and {j[0] for jobs in held for j in jobs} == closed


def test_states_of_groups_end(spark, tmp_path):
    """A job every three days, closed at once, kept for two; and snapshots of jobs that never come."""
    import datetime as dt

    first = dt.datetime(2024, 1, 1)
    days = [(f"j{k}", k, first + dt.timedelta(days=k), "completed", None, None, None, None, None, None) for k in (0, 3, 6)]
    shots = spark.createDataFrame([("gone", "failed", ""), ("waits", "queued", ""), (None, "queued", "")], "job_id string, status string, step string")
    path = str(tmp_path / "in")
    for row in days:
        sinks.append(spark.createDataFrame([row], SCHEMA).coalesce(1), path)
        for name, start in (
            ("cut", lambda e, *to: streams.follow_until_closed(e, *to, delay="1 hour", keep="2 days", groups=2)),
            ("tail", lambda e, *to: streams.follow_snapshot_tail(shots, e, *to, delay="1 hour", keep="2 days", groups=2)),
            ("silence", lambda e, *to: streams.follow_silence(e, *to, 2 * 86_400, groups=2)),
        ):
            stream = files.event_stream(spark, path, schema=SCHEMA)
            run(start(stream, str(tmp_path / name), str(tmp_path / f"{name}-cp")))
            held = {j[0] for jobs in groups_held(spark, str(tmp_path / f"{name}-cp")) for j in jobs}
            assert held - {"gone"} == {row[0]} and ("gone" in held) == (name == "tail" and row is days[0]), name
    assert spark.read.parquet(str(tmp_path / "tail")).filter("seq = -1").count() == 3
    assert spark.read.parquet(str(tmp_path / "tail")).filter("seq >= 0").count() == 3


def test_intervals():
    assert streams.milliseconds("7 days") == 7 * 86_400_000
    assert streams.milliseconds("1 hour 30 seconds") == 3_630_000
    for wrong in ("", "7", "x days"):
        with pytest.raises(ValueError):
            streams.milliseconds(wrong)


# ---- E3 --------------------------------------------------------------------------------------


def test_events_that_come_again_are_counted_once_and_state_ends(spark, tmp_path):
    """Each event lands twice, in batches a day apart each; windows of a day leave the state."""
    import datetime as dt

    first = dt.datetime(2024, 1, 1)
    rows = [
        (f"j{k % 40}", k, first + dt.timedelta(minutes=12 * k), "processing", "OCR", "ok", None, None, None, None)
        for k in range(1200)
    ]
    days = spark.createDataFrame(rows, SCHEMA)
    path, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    held = []
    for day in range(10):
        part = days.filter(F.col("seq").between(120 * day, 120 * day + 119))
        sinks.append(part.unionByName(part).coalesce(2), path)
        stream = files.event_stream(spark, path, schema=days.schema)
        query = streams.follow_state(stream, out, cp, delay="1 day", window="1 day")
        run(query)
        held.append([op["numRowsTotal"] for op in json.loads(query.lastProgress.json)["stateOperators"]])
    got = sinks.latest_states(spark.read.parquet(out))
    assert {r.n_events for r in got.collect()} == {30} and got.count() == 40
    assert {r.job_id: r.last_seq for r in got.collect()} == {f"j{k}": 1160 + k for k in range(40)}
    folds, seen = zip(*held, strict=True)
    assert max(folds) <= 40 * 4 and max(seen) <= 120 * 4  # ten days would be 400 folds and 1,200 events
    assert folds[-1] <= folds[3] and seen[-1] <= seen[3]


def test_stream_state_combines_before_its_shuffle(spark, events, tmp_path):
    fold = status.current_fold(events, F.window("ts", "1 day").alias("span"))
    assert "partial_max_by" in plan_of(fold, "simple")
    parts = [status.current_fold(events.filter(F.col("seq") % 3 == k)) for k in (1, 2, 0)]
    merged = status.merge_folds(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert states(merged) == slow_states()


# ---- E7 --------------------------------------------------------------------------------------


def test_snapshot_then_tail_as_a_stream(spark, events, tmp_path):
    """Snapshots of all kinds: older than the tail, terminal, without a tail, and none at all."""
    shots = [("hot", "processing", "OCR"), ("j1", "completed", ""), ("j2", "queued", ""), ("silent", "failed", "Qwen"), ("waits", "queued", "")]
    snapshots = spark.createDataFrame(shots, "job_id string, status string, step string")
    mine = events.filter(F.col("job_id").isin("hot", "j1", "j2", "j3"))
    out = str(tmp_path / "out")
    run(streams.follow_snapshot_tail(snapshots, landed(spark, mine, str(tmp_path / "in")), out, str(tmp_path / "cp")))
    seen = spark.read.parquet(out)
    got = streams.read_snapshot_tail(seen)
    want = status.snapshot_then_tail(snapshots, mine)
    columns = ["job_id", "seq", "status", "step", "error", "detail"]
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, want.select(columns).collect()), key=str)
    assert {r.job_id for r in got.filter("seq = -1").collect()} == {s[0] for s in shots}
    # a job's snapshot is sent no later than its first event
    first = seen.groupBy("job_id").agg(F.min(F.when(F.col("seq") == -1, F.col("batch_id"))).alias("shot"), F.min("batch_id").alias("first"))
    assert first.filter("shot > first").count() == 0


def test_snapshots_are_sent_once_over_restarts(spark, events, tmp_path):
    snapshots = spark.createDataFrame([("hot", "processing", "OCR")], "job_id string, status string, step string")
    path, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for half in (events.filter("seq < 10"), events.filter("seq >= 10")):
        run(streams.follow_snapshot_tail(snapshots, landed(spark, half, path), out, cp))
    seen = spark.read.parquet(out)
    assert seen.filter("seq = -1").count() == 1
    assert {(r.job_id, r.seq) for r in streams.read_snapshot_tail(seen).filter("seq >= 0").collect()} == slow_cut()


# ---- X4 --------------------------------------------------------------------------------------


def test_silence_as_it_happens(spark, tmp_path):
    import datetime as dt

    first = dt.datetime(2024, 1, 1)
    rows, expect = [], []
    script = [
        ("ends", 0, "processing"), ("stuck", 5, "processing"), ("resumes", 6, "queued"), ("late end", 7, "processing"),
        ("ends", 10, "completed"), ("new", 100, "queued"), ("resumes", 130, "processing"), ("late end", 140, "failed"),
        ("new", 190, "processing"),
    ]
    for seq, (job, minute, state) in enumerate(script):
        rows.append((job, seq, first + dt.timedelta(minutes=minute), state, None, None, None, None, None, None))
    every = spark.createDataFrame(rows, SCHEMA)
    path, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    now = int(first.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    for upto in (5, 6, 9):
        part = every.filter(F.col("seq").between(upto - {5: 5, 6: 1, 9: 3}[upto], upto - 1))
        sinks.append(part.coalesce(1), path)
        stream = files.event_stream(spark, path, schema=every.schema)
        run(streams.follow_silence(stream, out, cp, 3600, delay="10 minutes"))
        so_far = every.filter(F.col("seq") < upto)
        at = F.lit(now + 60_000_000 * max(m for _, m, _ in script[:upto]))
        want = reports.stuck_jobs(so_far, 3600, at).collect()
        got = streams.read_silence(spark.read.parquet(out), 3600, at).collect() if os.path.isdir(out) else []
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
        expect.append({r.job_id for r in want})
    assert expect == [set(), {"stuck", "resumes", "late end"}, {"stuck", "resumes"}]
    told = spark.read.parquet(out)
    assert told.filter("not stuck").count() >= 2  # those that went on
    with pytest.raises(ValueError):
        streams.follow_silence(stream, out, cp, 60, delay="1 hour")


# ---- E1 --------------------------------------------------------------------------------------


def test_a_batch_opens_only_the_folders_of_its_keys(spark, tmp_path):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 100 > 0, F.concat(F.lit("k"), "id")).alias("file_key"), F.col("id").alias("doc_id"), F.repeat(F.lit("text "), 50).alias("text")
    )
    table = keyed.save_keyed(rows, str(tmp_path / "table"), "file_key", 32)
    assert sorted(table.all(spark).drop(keyed.PART).collect(), key=str) == sorted(rows.collect(), key=str)
    one = spark.createDataFrame([("k7",), ("k7",), (None,), ("none",)], "file_key string")
    found = table.matching(one)
    assert [r.doc_id for r in found.collect()] == [7]
    plan = plan_of(found)
    assert "PartitionFilters: [key_part" in plan and "PushedFilters: [In(file_key" in plan
    read = {f.file for f in found.select(F.input_file_name().alias("file")).collect()}
    assert len(read) == 1 and len(glob.glob(str(tmp_path / "table" / "*" / "*.parquet"))) >= 30
    many = rows.filter("doc_id % 2 = 0 and file_key is not null").select("file_key")
    assert table.matching(many).count() == many.count()
    assert table.matching(one.limit(0)).count() == 0


def test_a_dealt_queue_has_each_batch_open_few_folders(spark, tmp_path):
    messages = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("file_key"), F.col("id").cast("string").alias("job_id"))
    messages = messages.unionByName(messages.limit(5).withColumn("file_key", F.lit(None).cast("string")))
    path, size = str(tmp_path / "queue"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "16k")
    try:
        keyed.append_dealt(messages, path, "file_key", 8)
    finally:
        spark.conf.unset(size)
    landed = spark.read.parquet(path)
    assert sorted(landed.select(messages.columns).collect(), key=str) == sorted(messages.collect(), key=str)
    files_of = landed.select(F.input_file_name().alias("f"), keyed.part_of("file_key", 8).alias("part"))
    opened = files_of.groupBy("f").agg(F.count_distinct("part").alias("n")).collect()
    assert len(opened) > 4 and max(r.n for r in opened) < 8 and sum(r.n for r in opened) < 4 * len(opened)


def test_a_batch_reads_its_documents_twice(spark, tmp_path):
    """Once for what is narrow, once for texts; jobs that are lost or broken are told from the narrow part."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def key(n):
        read.add(1)
        return f"k{n}"

    docs = spark.range(50).select(
        key.asNondeterministic()("id").alias("file_key"),
        F.col("id").alias("doc_id"),
        F.lit("Name: n").alias("text"),
        F.lit(None).cast("array<array<array<string>>>").alias("tables"),
        F.lit(0.5).alias("confidence"),
        F.when(F.col("id") == 3, "ValueError").alias("error_type"),
        F.lit("no page").alias("error_message"),
    )
    answers = spark.range(0, 50, 2).select(F.col("id").alias("doc_id"), F.lit('{"a": 1}').alias("response"))
    messages = spark.range(51).select(F.col("id").cast("string").alias("job_id"), F.concat(F.lit("k"), "id").alias("file_key"), F.lit("f").alias("filename"))
    sinks.append(messages.coalesce(1), str(tmp_path / "queue"))
    stream = files.queue_stream(spark, str(tmp_path / "queue"))
    out, events = str(tmp_path / "out"), str(tmp_path / "events")
    run(streams.run_jobs(stream, docs, answers, out, str(tmp_path / "cp"), events))
    assert read.value <= 2 * 50
    done = spark.read.parquet(out)
    assert {int(r.job_id) for r in done.collect()} == set(range(50)) - {3}
    assert {int(r.job_id) for r in done.filter("ai_extraction").collect()} == set(range(0, 50, 2))
    failed = spark.read.parquet(events).filter("status = 'failed'").collect()
    assert {(r.job_id, r.error) for r in failed} == {("3", "ValueError: no page"), ("50", "Storage download failed: k50")}


def test_near_rows_hold_all_matching_ones(spark, tmp_path, monkeypatch):
    rows = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("file_key"), F.col("id").alias("doc_id"))
    table = keyed.save_keyed(rows, str(tmp_path / "table"), "file_key", 4)
    asked = rows.filter("doc_id < 2000").select("file_key")
    assert {r.doc_id for r in table.near(asked).collect()} == set(range(2000))
    assert "SortMergeJoin" not in plan_of(table.near(asked), "simple")
    monkeypatch.setattr(keyed, "SENT_KEYS", 1)
    assert {r.doc_id for r in table.near(asked).collect()} >= set(range(2000))
    assert table.matching(asked).count() == 2000


def test_jobs_stream_with_keyed_tables(spark, tmp_path):
    docs = spark.range(200).select(
        F.concat(F.lit("k"), "id").alias("file_key"),
        F.col("id").alias("doc_id"),
        F.concat(F.lit("Name: n"), "id").alias("text"),
        F.lit(None).cast("array<array<array<string>>>").alias("tables"),
        F.lit(0.5).alias("confidence"),
    )
    answers = spark.range(0, 200, 2).select(F.col("id").alias("doc_id"), F.lit('{"a": 1}').alias("response"))
    messages = docs.select(F.col("doc_id").cast("string").alias("job_id"), "file_key", F.lit("f").alias("filename"))
    sinks.append(messages.repartition(3), str(tmp_path / "queue"))
    outs = []
    for n, tables in enumerate(
        ((docs, answers), (keyed.save_keyed(docs, str(tmp_path / "d"), "file_key", 8), keyed.save_keyed(answers, str(tmp_path / "a"), "doc_id", 8)))
    ):
        stream = files.queue_stream(spark, str(tmp_path / "queue"), files_per_trigger=1)
        run(streams.run_jobs(stream, *tables, str(tmp_path / f"out{n}"), str(tmp_path / f"cp{n}")))
        rows = sinks.latest_per_job(spark.read.parquet(str(tmp_path / f"out{n}")))
        outs.append(sorted(rows.select("job_id", "doc_id", "kv_found", "ai_extraction", "cleaned_text").collect()))
    assert outs[0] == outs[1] and len(outs[0]) == 200


def test_rows_of_other_keys_are_not_shuffled(spark, tmp_path, monkeypatch):
    rows = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("file_key"), F.repeat(F.lit("t"), 20).alias("text"))
    table = keyed.save_keyed(rows, str(tmp_path / "table"), "file_key", 4)
    asked = rows.limit(3000).select("file_key").unionByName(spark.createDataFrame([("none",)], "file_key string"))
    first = table.matching(asked)._jdf.queryExecution().optimizedPlan().toString()
    assert first.count("Join LeftSemi") == 2 and "xxhash64(file_key" in first
    assert table.matching(asked).count() == 3000
    monkeypatch.setattr(keyed, "SENT_KEYS", 2000)
    assert table.matching(asked).count() == 3000


def test_no_result_is_shuffled_for_its_answer(spark, tmp_path):
    """Documents that repeat a file or an id, have none, or several answers: as a left join by id gives them."""
    docs = spark.createDataFrame(
        [("a", 1, "x: 1"), ("a", 2, "y: 2"), ("b", 1, "z: 3"), ("b", None, "n: 4"), ("b", 1, "z: 3"), ("c", 3, "c: 5")],
        "file_key string, doc_id long, text string",
    )
    answers = spark.createDataFrame([(1, "p"), (1, "q"), (3, None), (None, "r"), (9, "s")], "doc_id long, response string")
    got = streams._with_answers(docs, docs.select("file_key", "doc_id"), answers)
    want = docs.join(answers, "doc_id", "left").select("file_key", "doc_id", "text", "response")
    assert sorted(got.select(want.columns).collect(), key=str) == sorted(want.collect(), key=str)
    by_id = [line for line in plan_of(got).split("\n") if "Arguments: hashpartitioning(doc_id" in line]
    assert "text" not in " ".join(by_id)


def test_changes_of_the_last_run_of_a_job(spark, tmp_path):
    """As folding the events of the last run gives them, whatever an earlier run had left."""
    columns = "job_id string, generation long, batch_id long, seq int, status string, step string, error string, ts timestamp"
    runs = {("a", 1, 0): "failed", ("a", 1, 3): "completed", ("a", 2, 0): "completed", ("b", 2, 1): "failed", ("b", 1, 7): "completed"}
    rows = []
    for (job, generation, batch), end in runs.items():
        rows += [(job, generation, batch, 0, "processing", f"OCR {batch}", None, None)]
        rows += [(job, generation, batch, 1, end, None, "broken" if end == "failed" else None, None)]
    events = spark.createDataFrame(rows, columns)
    for generation, batch in {(g, b) for _, g, b in runs}:
        own = events.filter((F.col("generation") == generation) & (F.col("batch_id") == batch)).drop("generation", "batch_id")
        sinks.save_batch(status.job_changes(own), str(tmp_path / "changes"), batch, generation)
    got = streams.latest_changes(spark.read.parquet(str(tmp_path / "changes")))
    want = status.job_changes(streams.ordered(events))
    shown = ["job_id", "status", "current_step", "error", "status_seq is null", "error_seq is null", "completed_seq is null"]
    assert sorted(map(tuple, got.selectExpr(shown).collect()), key=str) == sorted(map(tuple, want.selectExpr(shown).collect()), key=str)
    assert {r.job_id: r.error for r in got.collect()} == {"a": None, "b": "broken"}


# ---- S8 --------------------------------------------------------------------------------------


def files_of(folder):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/rows/*/*.parquet")}


def test_fold_replaces_touched_folders_only(spark, events, tmp_path):
    jobs = job_rows(spark)
    table = JobTable(str(tmp_path / "table"), 64, jobs.schema)
    table.create(jobs)
    before = files_of(table.path)
    assert table.fold(spark) == []
    mine = events.filter(F.col("job_id").isin("hot", "j1", "j2"))
    table.add(status.job_changes(mine), 0)
    assert files_of(table.path) == before  # a delta touches no row
    seen = as_tuples(table.read(spark))
    assert {j: seen[j] for j in ("hot", "j1", "j2")} == {j: want_rows()[j] for j in ("hot", "j1", "j2")}
    touched = table.fold(spark)
    after = files_of(table.path)
    assert 1 <= len(touched) <= 3
    folder = lambda f: int(f.split("key_part=")[1].split("/")[0])
    assert {f for f in before if folder(f) not in touched} == {f for f in after if folder(f) not in touched}
    assert all(after[f] == t for f, t in before.items() if folder(f) not in touched)
    assert not {f for f in before if folder(f) in touched} & set(after)
    assert as_tuples(table.read(spark)) == seen and table.open_deltas(spark).count() == 0


def test_a_crash_between_delta_and_fold_or_fold_and_mark_changes_nothing(spark, events, tmp_path, monkeypatch):
    jobs = job_rows(spark)
    table = JobTable(str(tmp_path / "table"), 8, jobs.schema)
    table.create(jobs)
    parts = [events.filter(F.col("seq") % 4 == k) for k in (2, 0, 3, 1)]  # out of order, too
    table.add(status.job_changes(parts[0]), 0)  # and the fold does not come
    table.add(status.job_changes(parts[1]), 1)
    saved = sinks.save_batch

    def broken(df, path, *place):
        if path.endswith("/folded"):
            raise OSError("lost")
        saved(df, path, *place)

    monkeypatch.setattr(sinks, "save_batch", broken)
    with pytest.raises(OSError):
        table.fold(spark)
    monkeypatch.undo()
    assert table.open_deltas(spark).select("batch_id").distinct().count() == 2
    table.add(status.job_changes(parts[1]), 1)  # the batch runs again
    table.fold(spark)
    table.add(status.job_changes(parts[2]), 2)
    table.add(status.job_changes(parts[3]), 0, generation=5)
    assert as_tuples(table.read(spark)) == want_rows()
    table.fold(spark)
    assert as_tuples(table.read(spark)) == want_rows()


def test_stream_into_the_job_table(spark, events, tmp_path):
    jobs = job_rows(spark)
    table = JobTable(str(tmp_path / "table"), 8, jobs.schema)
    table.create(jobs)
    run(streams.follow_into_table(landed(spark, events, str(tmp_path / "in")), table, str(tmp_path / "cp"), fold_every=2))
    assert table.open_deltas(spark).select("batch_id").distinct().count() == 1
    assert as_tuples(table.read(spark)) == want_rows()
    assert len(by_job()) + 1 == table.read(spark).count()
