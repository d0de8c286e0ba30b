"""Admission, registration, object lookup and job reads."""

import datetime as dt
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from docloom.functions import files, quality
from docloom.operators import admission, jobs
from tests.conftest import plan_of


def test_admission_splits_the_input(spark):
    limit = 20 * 1024 * 1024
    rows = [("a", "x.pdf", limit), ("b", "x.pdf", limit + 1), ("c", None, 1), ("d", "x.exe", 0)]
    uploads = spark.createDataFrame(rows, "job_id string, filename string, file_size bigint")
    got = {r.job_id: (r.reject_reason, r.http_code) for r in admission.admit(uploads).collect()}
    assert got == {
        "a": (None, 201),
        "b": ("max 20 MB", 413),
        "c": ("file required", 400),
        "d": (None, 201),
    }
    checked = {r.job_id: r.reject_reason for r in admission.admit(uploads, check_type=True).collect()}
    assert checked["d"] == "unsupported type" and checked["a"] is None
    registered = admission.register(uploads).collect()
    assert {r.job_id: (r.file_key, r.status) for r in registered} == {
        "a": ("uploads/a/x.pdf", "queued"),
        "d": ("uploads/d/x.exe", "queued"),
    }
    assert len(registered) + sum(1 for v in got.values() if v[0]) == len(rows)


def test_names(spark):
    names = ["a.pdf", "A.JPeG", "x.tar.gz", "README", ".hidden", "a.", "d.ir/f", "d/x.DOC", "sheet.xls", "pdf", "a/.b", "..c"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    rows = df.select(
        "n",
        files.extension(F.col("n")).alias("ext"),
        files.suffix(F.col("n")).alias("suffix"),
        files.file_kind(F.col("n")).alias("kind"),
        files.is_accepted(F.col("n")).alias("ok"),
    ).collect()
    for r in rows:
        assert r.ext == r.n.split(".")[-1].lower()
        assert r.suffix == PurePosixPath(r.n).suffix, r.n
    assert {r.n: r.kind for r in rows if r.kind != "other"} == {
        "a.pdf": "pdf",
        "A.JPeG": "image",
        "d/x.DOC": "word",
        "sheet.xls": "sheet",
        "pdf": "pdf",
    }
    assert {r.n for r in rows if r.ok} == {"a.pdf", "A.JPeG", "d/x.DOC", "sheet.xls", "pdf"}


def job_table(spark, n=200):
    day = dt.datetime(2024, 1, 1)
    rows = [
        (
            f"job-{i:04d}",
            f"f{i}.pdf",
            f"uploads/job-{i:04d}/f{i}.pdf",
            i,
            ("queued", "processing", "completed", "failed")[i % 4],
            None,
            f'{{"n": {i}}}' if i % 4 == 2 else None,
            None,
            None,
            day + dt.timedelta(days=i // 10),
            day,
            None,
        )
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows,
        "job_id string, filename string, file_key string, file_size bigint, status string, "
        "current_step string, result string, error string, elapsed_ms int, created_at timestamp, "
        "updated_at timestamp, completed_at timestamp",
    )


def test_reads(spark):
    table = job_table(spark)
    asked = spark.createDataFrame([("job-0000",), ("job-0002",), ("nope",)], "job_id string")
    seen = {r.job_id: r for r in jobs.status_of_all(table, asked).collect()}
    assert {k: v.http_code for k, v in seen.items()} == {"job-0000": 200, "job-0002": 200, "nope": 404}
    assert "result" not in seen["job-0000"].asDict()
    results = {r.job_id: (r.http_code, r.status, r.result) for r in jobs.result_of_all(table, asked).collect()}
    assert results == {
        "job-0000": (202, "queued", None),
        "job-0002": (200, "completed", '{"n": 2}'),
        "nope": (404, None, None),
    }
    assert jobs.status_of(table, "job-0003").first().status == "failed"
    assert jobs.status_of(table, "nope").count() == 0


def test_recent_jobs_are_a_top_k(spark):
    table = job_table(spark)
    got = [r.job_id for r in jobs.recent(table).collect()]
    rows = sorted(table.collect(), key=lambda r: r.job_id)
    rows.sort(key=lambda r: r.created_at, reverse=True)
    assert got == [r.job_id for r in rows[:50]]
    assert jobs.recent_count(table).first()["count"] == 50
    assert "TakeOrderedAndProject" in plan_of(jobs.recent(table))
    small = job_table(spark, 7)
    assert jobs.recent_count(small).first()["count"] == 7


def test_missing_object_fails_the_job(spark):
    queued = spark.createDataFrame([("a", "k1"), ("b", "k2")], "job_id string, file_key string")
    objects = spark.createDataFrame([("k1", 5), ("k9", 1)], "file_key string, length bigint")
    got = {r.job_id: (r.status, r.error, r.length) for r in admission.attach_files(queued, objects).collect()}
    assert got == {
        "a": ("processing", None, 5),
        "b": ("failed", "Storage download failed: k2", None),
    }


def test_labels(spark):
    rows = [("uploading", None), ("queued", "OCR"), ("processing", "OCR"), ("processing", ""), ("processing", None)]
    df = spark.createDataFrame(rows, "status string, step string")
    got = [r[0] for r in df.select(jobs.status_label(F.col("status"), F.col("step"))).collect()]
    assert got == ["Mengupload...", "Menunggu worker...", "OCR...", "Memproses...", "Memproses..."]
    assert spark.sql("select 'abcdefghij' as j").select(jobs.short_id(F.col("j"))).first()[0] == "abcdefgh"


def test_confidence_and_gate(spark):
    values = ["0.9496", "0.95", "n/a", None, "1", "0.944500001", "0.8765", "1.2", "0"]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    known = df.select(quality.confidence_or_default(F.col("c")).alias("c"))
    rows = known.select("c", quality.quality_score(F.col("c")).alias("s"), quality.passes_gate(F.col("c")).alias("p")).collect()
    assert [r.c for r in rows] == [0.9496, 0.95, 1.0, 1.0, 1.0, 0.944500001, 0.8765, 1.2, 0.0]
    for r in rows:
        assert r.s == round(r.c * 100, 1)
        assert r.p == (r.c * 100 >= 95.0)
    assert (rows[0].s, rows[0].p) == (95.0, False)
    card = spark.createDataFrame([(120.5,), (None,), (94.0,)], "s double").select(
        quality.bar_value(F.col("s")), quality.score_text(F.col("s"))
    )
    assert [tuple(r) for r in card.collect()] == [(100.0, "120.5%"), (0.0, "—"), (94.0, "94.0%")]


def test_rounding_follows_the_binary_value(spark):
    from docloom.functions.rounding import round_binary

    values = [i / 200 for i in range(20000)] + [i / 20 for i in range(2000)] + [2.675, 1149.965, -0.125, -2.675]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", round_binary(F.col("x"), 1).alias("a"), round_binary(F.col("x"), 2).alias("b")).collect():
        assert (r.a, r.b) == (round(r.x, 1), round(r.x, 2)), r.x
