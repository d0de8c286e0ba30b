"""Queries over uploads and the job table."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import files
from docloom.operators import admission, jobs
from docloom.plans.registry import query
from docloom.plans.views import table, view
from docloom.session import shared_dir
from docloom.sources import files as file_source
from docloom.sources import sinks

_ADMITTED = "filename is not null and file_size <= 20971520"
_QUEUED = f"""select cast(job_id as string) as job_id, filename,
  concat('uploads/', cast(job_id as string), '/', filename) as file_key from uploads where {_ADMITTED}"""
# Fixed values below: lists of types and labels, as the functions have them.
_EXT = "lower(split_part(filename, '.', -1))"


@query(
    "doc_scan",
    """select page_id, octet_length(encode(html)) + 1 as file_size, cast(null as varchar) as reject_reason,
  sha256(html || chr(10)) as digest from pages""",
)
def doc_scan(spark, sf_dir):
    """Every page as a stored file, listed, and those within the limit read: sizes and digests."""
    path = shared_dir(spark, "page-files")
    sinks.save_texts(table(spark, sf_dir, "pages"), path, "page_id", "html")
    page = F.regexp_extract("path", "page_id=([0-9]+)", 1).cast("bigint").alias("page_id")
    found = file_source.found_files(spark, path)
    refused = file_source.list_files(spark, path, found=found).filter(F.col("file_size") > files.MAX_BYTES)
    read = file_source.read_documents(spark, path, found=found).select(
        page,
        "file_size",
        F.lit(None).cast("string").alias("reject_reason"),
        F.sha2("content", 256).alias("digest"),
    )
    return read.unionByName(
        refused.select(
            page,
            "file_size",
            F.lit(files.TOO_LARGE).alias("reject_reason"),
            F.lit(None).cast("string").alias("digest"),
        )
    )


@query(
    "admission",
    """select job_id, filename, file_size,
  case when filename is null then 'file required' when file_size > 20971520 then 'max 20 MB' end as reject_reason,
  case when filename is null then 400 when file_size > 20971520 then 413 else 201 end as http_code
from uploads""",
)
def admit(spark, sf_dir):
    return admission.admit(view(spark, sf_dir, "uploads"))


@query(
    "register_jobs",
    f"""select job_id, filename, file_size, concat('uploads/', cast(job_id as string), '/', filename) as file_key,
  'queued' as status, concat('/ws/jobs/', cast(job_id as string)) as ws_url from uploads where {_ADMITTED}""",
)
def register_jobs(spark, sf_dir):
    return admission.register(view(spark, sf_dir, "uploads"))


@query("queue_publish", _QUEUED)
def queue_publish(spark, sf_dir):
    """Messages written to a landing folder and read back."""
    path = shared_dir(spark, "queue")
    sinks.append(admission.queue_messages(admission.register(view(spark, sf_dir, "uploads"))), path)
    return spark.read.parquet(path)


@query(
    "queue_defaults",
    """select cast(job_id as string) as job_id, concat_ws('/', 'uploads', cast(job_id as string), filename) as file_key,
  coalesce(filename, 'unknown') as filename from uploads""",
)
def queue_defaults(spark, sf_dir):
    """Messages of all uploads, also those that came without a file name."""
    uploads = view(spark, sf_dir, "uploads")
    keyed = uploads.withColumn("file_key", files.file_key(F.col("job_id"), F.col("filename")))
    return admission.default_names(admission.queue_messages(keyed))


@query(
    "attach_files",
    """select j.job_id, j.file_key, o.length, case when o.file_key is null then 'failed' else 'processing' end as status,
  case when o.file_key is null then concat('Storage download failed: ', j.file_key) end as error
from jobs j left join objects o on o.file_key = j.file_key""",
)
def attach_files(spark, sf_dir):
    queued = view(spark, sf_dir, "jobs").select("job_id", "file_key")
    return admission.attach_files(queued, view(spark, sf_dir, "objects"))


_REQUESTED = "from requested r left join jobs j on j.job_id = r.job_id"


@query(
    "job_status",
    f"""select r.job_id, filename, file_size, status, current_step, error, elapsed_ms, created_at, updated_at,
  completed_at, case when status is null then 404 else 200 end as http_code {_REQUESTED}""",
)
def job_status(spark, sf_dir):
    return jobs.status_of_all(view(spark, sf_dir, "jobs"), view(spark, sf_dir, "requested"))


@query(
    "job_result",
    f"""select r.job_id, status, case when status = 'completed' then result end as result,
  case when status is null then 404 when status = 'completed' then 200 else 202 end as http_code {_REQUESTED}""",
)
def job_result(spark, sf_dir):
    return jobs.result_of_all(view(spark, sf_dir, "jobs"), view(spark, sf_dir, "requested"))


_RECENT = """select job_id, filename, file_size, status, current_step, elapsed_ms, created_at from jobs
order by created_at desc, job_id limit 50"""


@query("recent_jobs", _RECENT)
def recent_jobs(spark, sf_dir):
    return jobs.recent(view(spark, sf_dir, "jobs"))


@query("recent_jobs_count", f"select count(*) as count from ({_RECENT}) r")
def recent_jobs_count(spark, sf_dir):
    return jobs.recent_count(view(spark, sf_dir, "jobs"))


@query(
    "status_snapshot",
    "select job_id, status, coalesce(current_step, '') as step, error from jobs",
)
def status_snapshot(spark, sf_dir):
    return jobs.snapshot(view(spark, sf_dir, "jobs"))


@query(
    "accepted_types",
    f"""select job_id, filename, coalesce({_EXT} in ('png', 'jpg', 'jpeg', 'bmp', 'tiff', 'tif', 'webp', 'pdf', 'docx', 'doc',
  'xlsx', 'xls'), false) as is_accepted from uploads""",
)
def accepted_types(spark, sf_dir):
    named = view(spark, sf_dir, "uploads").select("job_id", "filename")
    return named.withColumn("is_accepted", files.is_accepted(F.col("filename")))


_IMAGE = f"{_EXT} in ('png', 'jpg', 'jpeg', 'bmp', 'tiff', 'tif', 'webp')"


@query(
    "file_kind",
    f"""select job_id, filename, {_EXT} as extension, coalesce({_IMAGE}, false) as is_image,
  case when {_EXT} = 'pdf' then 'pdf' when {_EXT} in ('xlsx', 'xls') then 'sheet'
    when {_EXT} in ('docx', 'doc') then 'word' when {_IMAGE} then 'image' else 'other' end as kind from uploads""",
)
def file_kind(spark, sf_dir):
    name = F.col("filename")
    return view(spark, sf_dir, "uploads").select(
        "job_id",
        "filename",
        files.extension(name).alias("extension"),
        files.is_image(name).alias("is_image"),
        files.file_kind(name).alias("kind"),
    )


@query(
    "file_suffix",
    """select job_id, filename, case when filename is null then null
  when strpos(reverse(part), '.') in (0, 1, length(part)) then ''
  else right(part, strpos(reverse(part), '.')::int) end as suffix
from (select job_id, filename, split_part(filename, '/', -1) as part from uploads) p""",
)
def file_suffix(spark, sf_dir):
    named = view(spark, sf_dir, "uploads").select("job_id", "filename")
    return named.withColumn("suffix", files.suffix(F.col("filename")))


@query(
    "job_labels",
    """select job_id, left(cast(job_id as string), 8) as short_id,
  case when status = 'uploading' then 'Mengupload...' when status = 'queued' then 'Menunggu worker...'
    when coalesce(step, '') <> '' then concat(step, '...') else 'Memproses...' end as label
from (select cast(job_id as string) as job_id, status, current_step as step from jobs
  union all select job_id, status, step from status_events) s""",
)
def job_labels(spark, sf_dir):
    stored = view(spark, sf_dir, "jobs").select(
        F.col("job_id").cast("string"), "status", F.col("current_step").alias("step")
    )
    seen = stored.unionByName(view(spark, sf_dir, "status_events").select("job_id", "status", "step"))
    return seen.select(
        "job_id",
        jobs.short_id(F.col("job_id")).alias("short_id"),
        jobs.status_label(F.col("status"), F.col("step")).alias("label"),
    )


@query(
    "in_progress",
    "select job_id, status, status in ('uploading', 'queued', 'processing') as in_progress from jobs",
)
def in_progress(spark, sf_dir):
    listed = view(spark, sf_dir, "jobs").select("job_id", "status")
    return listed.withColumn("in_progress", jobs.is_in_progress(F.col("status")))
