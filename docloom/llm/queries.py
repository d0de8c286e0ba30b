"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its check in DuckDB, where SQL can express it."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


from docloom.llm import (  # noqa: E402,F401  each module adds its queries
    alignment_query,
    attention_query,
    collocation_query,
    decontamination_query,
    extraction_query,
    jaccard_query,
    language_query,
    license_query,
    packing_query,
    preference_query,
    quality_query,
    toxicity_query,
    url_query,
)
