"""Reads over the job table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import schemas as S

# Length of the job list, of a short id, and the labels of the waiting states.
LIST_LENGTH = 50
SHORT_ID = 8
LABEL_UPLOADING, LABEL_QUEUED, LABEL_DEFAULT = "Mengupload...", "Menunggu worker...", "Memproses..."

STATUS_COLUMNS = (
    "job_id",
    "filename",
    "file_size",
    "status",
    "current_step",
    "error",
    "elapsed_ms",
    "created_at",
    "updated_at",
    "completed_at",
)
LIST_COLUMNS = (
    "job_id",
    "filename",
    "file_size",
    "status",
    "current_step",
    "elapsed_ms",
    "created_at",
)


def status_of(jobs: DataFrame, job_id) -> DataFrame:
    """Q1 for one job; the filter reaches the scan. No row means not found."""
    return jobs.filter(F.col("job_id") == job_id).select(*STATUS_COLUMNS)


def status_of_all(jobs: DataFrame, requested: DataFrame) -> DataFrame:
    """Q1 for many: each requested ``job_id`` with the job's status columns and 200 or 404."""
    known = jobs.select(*STATUS_COLUMNS)
    return requested.join(known, "job_id", "left").withColumn(
        "http_code", F.when(F.col("status").isNull(), 404).otherwise(200)
    )


def result_of_all(jobs: DataFrame, requested: DataFrame) -> DataFrame:
    """Q2: only a completed job shows its result (200); else its status (202) or nothing (404)."""
    known = jobs.select("job_id", "status", "result")
    done = F.col("status") == S.COMPLETED
    return (
        requested.join(known, "job_id", "left")
        .withColumn("result", F.when(done, F.col("result")))
        .withColumn(
            "http_code",
            F.when(F.col("status").isNull(), 404).when(done, 200).otherwise(202),
        )
    )


def recent(jobs: DataFrame, length: int = LIST_LENGTH) -> DataFrame:
    """Q3: newest jobs first; the job id settles equal times."""
    return (
        jobs.select(*LIST_COLUMNS)
        .orderBy(F.col("created_at").desc(), F.col("job_id"))
        .limit(length)
    )


def recent_count(jobs: DataFrame, length: int = LIST_LENGTH) -> DataFrame:
    """Q4: length of the list of Q3, not of the table."""
    return recent(jobs, length).agg(F.count(F.lit(1)).alias("count"))


def snapshot(jobs: DataFrame) -> DataFrame:
    """Q5: what a viewer gets on connecting."""
    return jobs.select(
        "job_id",
        "status",
        F.coalesce(F.col("current_step"), F.lit("")).alias("step"),
        "error",
    )


def short_id(job_id: Column) -> Column:
    """Q11."""
    return F.substring(job_id.cast("string"), 1, SHORT_ID)


def status_label(status: Column, step: Column) -> Column:
    """Q11: the text shown while a job is under way."""
    return (
        F.when(status == "uploading", LABEL_UPLOADING)
        .when(status == S.QUEUED, LABEL_QUEUED)
        .when(F.coalesce(step, F.lit("")) != "", F.concat(step, F.lit("...")))
        .otherwise(LABEL_DEFAULT)
    )


def is_in_progress(status: Column) -> Column:
    """Q12."""
    return status.isin("uploading", S.QUEUED, S.PROCESSING)
