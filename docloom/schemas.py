"""Schemas of the records that enter and leave the package."""

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "timestamp": T.TimestampType(),
    "tables": T.ArrayType(T.ArrayType(T.ArrayType(T.StringType()))),
}


def _struct(fields: str) -> T.StructType:
    """Schema of ``name type`` pairs; needs no session, unlike parsing DDL."""
    pairs = [f.split() for f in fields.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


#: One row per job.
JOB = _struct(
    "job_id string, filename string, file_key string, file_size bigint, status string, "
    "current_step string, result string, error string, elapsed_ms int, "
    "created_at timestamp, updated_at timestamp, completed_at timestamp"
)

#: One message per queued job.
QUEUE_MESSAGE = _struct("job_id string, file_key string, filename string")

#: All status event shapes in one row; fields that a shape lacks are null.
STATUS_EVENT = _struct(
    "job_id string, status string, step string, step_status string, detail string, "
    "elapsed_s double, elapsed_ms int, error string, timestamp double"
)

#: A document after conversion to text.
CONVERTED = _struct("doc_id string, text string, tables tables, confidence double")

#: What the model answered for a document; null when the call failed.
RESPONSE = _struct("doc_id string, response string")

# Job states, step names and the labels of the step overview.
QUEUED, PROCESSING, COMPLETED, FAILED = "queued", "processing", "completed", "failed"
TERMINAL = (COMPLETED, FAILED)
STEP_OCR, STEP_CLEAN, STEP_MODEL, STEP_VALIDATE = "OCR", "Clean Text", "Qwen", "Validate JSON"
STEP_STORE = "Database"
STEP_LABELS = (STEP_OCR, STEP_CLEAN, STEP_MODEL, STEP_VALIDATE, STEP_STORE)
