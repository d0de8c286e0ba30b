"""Reports against plain Python: totals, top keys, daily states, types of fields."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.functions import model
from docloom.operators import reports
from tests.conftest import plan_of


def test_rollup_totals(spark):
    rows = [("done", "2024-01-01", 5, 10), ("done", "2024-01-02", 7, None), ("queued", "2024-01-01", 1, None), (None, None, 2, 4)]
    jobs = spark.createDataFrame(rows, "status string, day string, file_size long, elapsed_ms int")
    got = reports.status_rollup(jobs.withColumn("created_at", F.to_timestamp("day")))
    seen = {(r.level, r.status, str(r.day)): (r.jobs, r.bytes, r.mean_elapsed_ms) for r in got.collect()}
    assert seen[3, None, "None"] == (4, 15, 7.0)
    assert seen[1, "done", "None"] == (2, 12, 10.0) and seen[2, None, "2024-01-01"] == (2, 6, 10.0)
    # a null status and day are groups of their own, told apart by the level
    assert seen[0, None, "None"] == (1, 2, 4.0) == seen[1, None, "None"] == seen[2, None, "None"]
    assert len(seen) == got.count() == 4 + 3 + 3 + 1


def plain_top(keys, count):
    return sorted(Counter(k for k in keys if k is not None).items(), key=lambda x: (-x[1], x[0]))[:count]


@pytest.mark.parametrize(("spread", "tracked"), [(1.2, 64), (1.2, 4096), (0.0, 16)])
def test_top_keys_are_exact(spark, spread, tracked):
    """Skewed keys, which the sketch proves; and even ones with ties, which are counted."""
    rng = random.Random(4)
    keys = [f"k{min(int(rng.paretovariate(spread)), 3000)}" if spread else f"k{n % 400}" for n in range(20_000)] + [None] * 50
    rows = spark.createDataFrame([(k, 1) for k in keys], "key string, documents int").repartition(6)
    for count in (1, 5, 40):
        got = [tuple(r) for r in reports.top_keys(rows, count, tracked).collect()]
        assert got == plain_top(keys, count)
    assert reports.top_keys(rows.limit(0), 3).collect() == []
    with pytest.raises(ValueError):
        reports.top_keys(rows, 0)


def test_top_keys_shuffle_no_key_when_the_bound_holds(spark):
    rows = spark.range(100_000).select(F.when(F.col("id") % 10 < 9, F.lit("hot")).otherwise(F.concat(F.lit("k"), "id")).alias("key"))
    got = reports.top_keys(rows, 1)
    assert "Exchange" not in plan_of(got) and got.first().documents == 90_000


def test_daily_states_merge_to_whole_reports(spark):
    """One day holds most rows, another a single one."""
    rng = random.Random(9)
    rows = []
    for n in range(30_000):
        day = "mon" if n % 10 else rng.choice(["tue", "wed"])
        rows.append((day, "many", f"v{rng.randrange(8000)}"))
        if n % 3 == 0:
            rows.append((day, "few", f"v{rng.randrange(5)}"))
    rows.append(("thu", "once", "x"))
    frame = spark.createDataFrame(rows, "day string, key string, val string")
    states = reports.daily_coverage(frame)
    assert states.count() == 7  # a row for each day and key
    merged = {r.key: r for r in reports.merged_coverage(states).collect()}
    for key in ("many", "few", "once"):
        values = [v for _, k, v in rows if k == key]
        assert merged[key].documents == len(values)
        assert abs(merged[key].distinct_values - len(set(values))) <= 0.05 * len(set(values))

    spent = [(rng.choice(["mon"] * 9 + ["tue"]), "OCR", rng.expovariate(0.1)) for _ in range(20_000)] + [("wed", "Qwen", 2.5), ("wed", "Qwen", None)]
    states = reports.daily_durations(spark.createDataFrame(spent, "day string, step string, elapsed_s double"))
    merged = {r.step: r for r in reports.merged_durations(states, 0.5, 0.9).collect()}
    times = sorted(s for _, step, s in spent if step == "OCR")
    for share, found in ((0.5, merged["OCR"].at_50), (0.9, merged["OCR"].at_90)):
        rank = sum(t <= found for t in times) / len(times)
        assert abs(rank - share) <= 0.02
    assert merged["OCR"].jobs == 20_000 and merged["OCR"].most_s == times[-1] and merged["OCR"].least_s == times[0]
    assert (merged["Qwen"].jobs, merged["Qwen"].at_50, merged["Qwen"].at_90) == (1, 2.5, 2.5)


def test_pass_rate_by_kind_and_source(spark):
    rows = [("a.pdf", "x", True), ("b.pdf", "y", False), ("c.png", "x", True), ("d", None, False)]
    got = reports.pass_rate(spark.createDataFrame(rows, "filename string, source string, passes boolean"))
    seen = {(r.level, r.kind, r.source): (r.documents, r.passed, r.rate) for r in got.collect()}
    assert seen[3, None, None] == (4, 2, 0.5) and seen[1, "pdf", None] == (2, 1, 0.5)
    assert seen[2, None, "x"] == (2, 2, 1.0) and seen[0, "other", None] == (1, 0, 0.0) and seen[2, None, None] == (1, 0, 0.0)


def test_types_and_names_of_found_fields(spark):
    answers = ['{"a": 1, "b": "x", "c": [1, "y"]}', '{"a": "one", "b": null}', "nothing", None, '{"a": 2, "d": {"e": true}}']
    rows = spark.createDataFrame([(a,) for a in answers], "response string")
    entries = rows.select(F.explode(model.parse_response(F.col("response"))).alias("e")).select("e.key", "e.value")
    got = {(r.key, r.kind): r.documents for r in reports.field_types(entries).collect()}
    assert got["a", "BIGINT"] == 2 and got["a", "STRING"] == 1 and got["b", "VOID"] == 1 and got["d", "OBJECT<e: BOOLEAN>"] == 1
    assert reports.found_keys(entries, 4) == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        reports.found_keys(entries, 3)
