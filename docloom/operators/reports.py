"""Reports over whole tables of jobs, fields, events and results.

All are aggregations that combine before they shuffle. Distinct values are counted in two steps, by
value and then by key, and quantiles come from counts per distinct value, so no task takes in all rows
of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import files, text
from docloom.functions.times import epoch_micros
from docloom.operators import status


def status_rollup(jobs: DataFrame) -> DataFrame:
    """Jobs, bytes and mean elapsed time for each status and day of creation, with totals of each status
    (day null), of each day (status null) and of all. ``level`` tells them from groups of null values: 0 for a
    status and day, 1 for a status, 2 for a day, 3 for all. A row is expanded to its four groups and combined
    before anything moves."""
    return (
        jobs.select("status", F.to_date("created_at").alias("day"), "file_size", "elapsed_ms")
        .cube("status", "day")
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.count(F.lit(1)).alias("jobs"),
            F.sum("file_size").alias("bytes"),
            (F.sum("elapsed_ms") / F.count("elapsed_ms")).alias("mean_elapsed_ms"),
        )
    )


def field_coverage(rows: DataFrame, documents: int) -> DataFrame:
    """Of each key in ``rows(key, val)``, one row per document and key: documents that have it,
    their share of all ``documents``, and distinct values."""
    by_value = rows.groupBy("key", "val").agg(F.count(F.lit(1)).alias("n"))
    by_key = by_value.groupBy("key").agg(
        F.sum("n").alias("documents"), F.count(F.lit(1)).alias("distinct_values")
    )
    return by_key.withColumn("share", F.col("documents") / F.lit(float(max(1, documents))))


def top_keys(rows: DataFrame, count: int, tracked: int = 4096) -> DataFrame:
    """The ``count`` keys of ``rows(key)`` that stand in most rows, with ``documents``; of equal ones the smaller
    names come first.

    A frequent-items sketch of ``tracked`` keys names candidates: one buffer a task is shuffled, however many keys
    there are. The candidates are counted anew. A sketch over N rows is wrong by 3.5 N / ``tracked`` at most, and
    a key that it leaves out stands in twice as many rows at most; so if the last of the first ``count``
    candidates stands in more, no other key can belong to them. If not, all keys are counted.
    """
    if tracked < 4 or count < 1:
        raise ValueError("count must be positive and tracked at least 4")
    keys = rows.select("key").filter(F.col("key").isNotNull())
    names = min(tracked, max(4 * count, 100))
    found = keys.agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(key, {names}, {tracked})").alias("items")
    ).first()
    order = (F.col("documents").desc(), F.col("key"))
    counted = keys.groupBy("key").agg(F.count(F.lit(1)).alias("documents"))
    items = found["items"] or []
    exact = keys.filter(F.col("key").isin([i["item"] for i in items])).groupBy("key").agg(F.count(F.lit(1)).alias("documents"))
    best = exact.orderBy(*order).limit(count).collect()
    left_out = max(2 * 3.5 * found.n / tracked, items[-1]["count"] if len(items) == names else 0)
    if len(best) == count and best[-1].documents > left_out:
        return keys.sparkSession.createDataFrame(best, exact.schema)
    return counted.orderBy(*order).limit(count)


def daily_coverage(rows: DataFrame, lg_config: int = 12) -> DataFrame:
    """X2 as states of a day: of each ``day`` and ``key`` of ``rows(day, key, val)`` the rows and a sketch of the
    distinct values. Write them once a day; :func:`merged_coverage` takes any days together."""
    return rows.groupBy("day", "key").agg(
        F.count(F.lit(1)).alias("documents"), F.hll_sketch_agg("val", lg_config).alias("distinct_state")
    )


def merged_coverage(states: DataFrame) -> DataFrame:
    """X2 of the days in ``states``: documents, exact, and distinct values within a few hundredths."""
    return states.groupBy("key").agg(
        F.sum("documents").alias("documents"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_state")).alias("distinct_values"),
    )


def daily_durations(spent: DataFrame, k: int = 200) -> DataFrame:
    """X3 as states of a day: of each ``day`` and ``step`` of ``spent(day, step, elapsed_s)`` the closed steps, their
    least and greatest duration, and a sketch of the spread."""
    known = spent.filter(F.col("elapsed_s").isNotNull())
    return known.groupBy("day", "step").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.min("elapsed_s").alias("least_s"),
        F.max("elapsed_s").alias("most_s"),
        F.expr(f"kll_sketch_agg_double(elapsed_s, {k})").alias("spread_state"),
    )


def merged_durations(states: DataFrame, *shares: float) -> DataFrame:
    """X3 of the days in ``states``: as :func:`step_stats`, with ``at_<hundredths>`` for each share, a duration whose
    rank is within two hundredths of it."""
    merged = states.groupBy("step").agg(
        F.sum("jobs").alias("jobs"),
        F.min("least_s").alias("least_s"),
        F.max("most_s").alias("most_s"),
        F.expr("kll_merge_agg_double(spread_state)").alias("spread"),
    )
    return merged.select(
        "step",
        "jobs",
        "least_s",
        *[F.expr(f"kll_sketch_get_quantile_double(spread, {s})").alias(f"at_{round(100 * s)}") for s in shares],
        "most_s",
    )


def step_stats(events: DataFrame) -> DataFrame:
    """For each step the jobs that closed it and the spread of their durations in seconds."""
    spent = status.step_elapsed(events).filter(F.col("elapsed_s").isNotNull())
    counted = spent.groupBy("step", "elapsed_s").agg(F.count(F.lit(1)).alias("n"))

    def at(share: float) -> Column:
        return F.round(F.percentile("elapsed_s", F.lit(share), F.col("n")), 3)

    return counted.groupBy("step").agg(
        F.sum("n").alias("jobs"),
        F.min("elapsed_s").alias("least_s"),
        at(0.5).alias("median_s"),
        at(0.9).alias("p90_s"),
        F.max("elapsed_s").alias("most_s"),
    )


def stuck_jobs(events: DataFrame, cutoff_seconds: int, now: Column) -> DataFrame:
    """Jobs without a terminal event whose last event is ``cutoff_seconds`` or more before
    ``now`` (epoch microseconds). One aggregation, no second look at the events."""
    at = epoch_micros(events, "ts")
    stamped = events.withColumn("at", at)
    last = stamped.groupBy("job_id").agg(
        F.max("at").alias("last_at"),
        F.max_by("status", "seq").alias("status"),
        F.count_if(status.is_terminal(F.col("status"))).alias("closings"),
    )
    idle = now - F.col("last_at")
    return last.filter((F.col("closings") == 0) & (idle >= cutoff_seconds * 1_000_000)).select(
        "job_id", "status", F.floor(idle / 1_000_000).cast("bigint").alias("idle_s")
    )


def pass_rate(results: DataFrame) -> DataFrame:
    """Documents, passes and their share for each kind of file and source, with totals of each kind, each
    source and all, told apart by ``level`` as in :func:`status_rollup`; ``results(filename, source, passes)``."""
    return (
        results.select(files.file_kind(F.col("filename")).alias("kind"), "source", "passes")
        .cube("kind", "source")
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.count(F.lit(1)).alias("documents"),
            F.count_if("passes").alias("passed"),
        )
        .withColumn("rate", F.col("passed") / F.col("documents"))
    )


def pivot_fields(rows: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    """The values of chosen fields as columns, one row per document that has any of them.

    ``names`` maps each field to its column; ``rows`` has one row per document and key.
    """
    chosen = rows.filter(F.col("key").isin(*names))
    return chosen.groupBy(*keys).agg(
        *[F.max(F.when(F.col("key") == key, F.col("val"))).alias(name) for key, name in names.items()]
    )


def field_types(entries: DataFrame) -> DataFrame:
    """The fields that results really have: of each key and type of value in ``entries(key, value)``, with
    ``value`` a variant, the documents that have it."""
    kind = F.schema_of_variant("value").alias("kind")
    return entries.select("key", kind).groupBy("key", "kind").agg(F.count(F.lit(1)).alias("documents"))


def found_keys(entries: DataFrame, most: int) -> list[str]:
    """The keys of ``entries(key)`` by name, for a pivot without a list given beforehand. More than ``most`` are
    an error, not a cut: columns are a plan's, and a plan does not grow with the data."""
    keys = [r.key for r in entries.select("key").distinct().orderBy("key").limit(most + 1).collect()]
    if len(keys) > most:
        raise ValueError(f"more than {most} keys; choose some")
    return keys


def clean_impact(docs: DataFrame, *groups: str) -> DataFrame:
    """Documents, characters and rule lines that cleaning takes away, for each of ``groups``."""
    raw = F.length("text")
    rules = F.size(F.filter(text.doc_lines(F.col("text")), text.is_rule_line))
    measured = docs.select(
        *groups,
        raw.alias("raw"),
        (raw - F.length(text.clean_text(F.col("text")))).alias("removed"),
        rules.alias("rules"),
    )
    return measured.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("raw").cast("bigint").alias("raw_chars"),
        F.sum("removed").cast("bigint").alias("removed_chars"),
        F.sum("rules").cast("bigint").alias("rule_lines"),
    )

