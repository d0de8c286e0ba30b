"""The data side of model-based extraction: prompt, request, response, choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.arrays import last_per_key

# The bound on what the model is shown, the prompt texts and the request options.
MAX_CHARS = 2000
TRUNCATED_MARK = "\n[truncated]"
SYSTEM_PROMPT = "You are a JSON extraction API. Respond ONLY with valid JSON."
USER_PROMPT = """Extract all key-value information from this document as a flat JSON object.

Rules:
- Output ONLY valid JSON, nothing else
- No markdown, no explanation, no code fences
- Use the exact field names from the document
- Skip empty/blank fields
- Numbers and dates: keep original format

Document:
"""
MODEL = "qwen2.5:latest"
KEEP_ALIVE = "10m"
OPTIONS = {"temperature": 0, "num_predict": 800, "num_ctx": 2048, "num_gpu": 99}
TIMEOUT_SECONDS = 300
SOURCE_MODEL = "Qwen AI"
SOURCE_RULES = "Regex"


def truncate(text: Column, max_chars: int = MAX_CHARS) -> Column:
    """L1: what the model sees. Only the request is cut; extraction by rule reads whole texts."""
    cut = F.length(text) > max_chars
    return F.concat(
        F.substring(text, 1, max_chars), F.when(cut, TRUNCATED_MARK).otherwise("")
    )


def prompt(cleaned: Column, max_chars: int = MAX_CHARS) -> Column:
    """L2: user prompt for a cleaned text."""
    return F.concat(F.lit(USER_PROMPT), truncate(cleaned, max_chars))


def request(prompt_text: Column, model: str = MODEL) -> Column:
    """L3: request body as JSON text."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            F.array(
                message("system", F.lit(SYSTEM_PROMPT)), message("user", prompt_text)
            ).alias("messages"),
            F.lit(False).alias("stream"),
            F.lit(KEEP_ALIVE).alias("keep_alive"),
            F.struct(*[F.lit(v).alias(k) for k, v in OPTIONS.items()]).alias("options"),
        )
    )


def parse_response(response: Column) -> Column:
    """``array<struct<key, value: variant>>`` of the object at the first ``{``; else null.

    Text before and after the object does not matter; a later ``{`` is never tried. A repeated
    key keeps its first place and takes its last value.
    """
    start = F.locate("{", response)
    tail = F.substr(response, start)
    parsed = F.from_json(tail, "map<string,variant>", {"allowSingleQuotes": "false"})
    return last_per_key(F.map_entries(F.when(start > 0, parsed)))


def is_blank_value(value: Column) -> Column:
    """JSON null, ``""``, ``[]`` or ``{}``; the text ``"{}"``, 0 and false are values."""
    is_text = F.schema_of_variant(value) == "STRING"
    text = value.cast("string")
    return (
        F.is_variant_null(value)
        | (is_text & (text == ""))
        | (~is_text & text.isin("[]", "{}"))
    )


def prune(entries: Column) -> Column:
    """Entries without blank values; null stays null."""
    return F.filter(entries, lambda e: ~is_blank_value(e["value"]))


def is_model_result(entries: Column) -> Column:
    """The model counts if it gave a non-empty object, even one that pruning empties."""
    return F.coalesce(F.size(entries), F.lit(0)) > 0


def as_variants(fields: Column) -> Column:
    """Rule fields in the type of model fields."""
    return F.transform(
        fields,
        lambda f: F.struct(f["key"].alias("key"), f["value"].cast("variant").alias("value")),
    )


def choose(entries: Column, fields: Column) -> Column:
    """Pruned model fields, or the rule fields where the model gave nothing."""
    return F.when(is_model_result(entries), prune(entries)).otherwise(as_variants(fields))


def source_label(by_model: Column) -> Column:
    """L8."""
    return F.when(by_model, SOURCE_MODEL).otherwise(SOURCE_RULES)
