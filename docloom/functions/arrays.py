"""Array helpers that stay inside one row, so that no shuffle is needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``.

    A column that a lambda refers to is otherwise evaluated again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def change_where(
    value: Column, test: Callable[[Column], Column], change: Callable[[Column], Column]
) -> Column:
    """``change(value)`` where ``test(value)`` holds, else the value; computes ``value`` once."""
    return let(value, lambda v: F.when(test(v), change(v)).otherwise(v))


def _sorted_keys(entries: Column) -> Column:
    return F.array_sort(
        F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("pos")))
    )


def _starts(order: Column) -> Column:
    return F.filter(order, lambda x, j: (j == 0) | (F.get(order, j - 1)["key"] != x["key"]))


def _ends(order: Column) -> Column:
    return F.filter(
        order, lambda x, j: (j == F.size(order) - 1) | (F.get(order, j + 1)["key"] != x["key"])
    )


def _unless_unique(entries: Column, dedupe: Callable[[Column], Column]) -> Column:
    def body(e: Column) -> Column:
        keys = F.transform(e, lambda x: x["key"])
        return F.when(F.size(F.array_distinct(keys)) == F.size(e), e).otherwise(dedupe(e))

    return let(entries, body)


def first_per_key(entries: Column) -> Column:
    """Entries ``array<struct<key, value>>`` without later repeats of a key, in original order.

    Sorts (key, position) pairs, so the cost is n log n per row even if one key fills the row.
    """

    def dedupe(e: Column) -> Column:
        firsts = let(_sorted_keys(e), lambda order: F.transform(_starts(order), lambda x: x["pos"]))
        return F.transform(F.array_sort(firsts), lambda p: F.get(e, p))

    return _unless_unique(entries, dedupe)


def last_per_key(entries: Column) -> Column:
    """Entries where a repeated key keeps its first place and takes its last value."""

    def dedupe(e: Column) -> Column:
        spans = let(
            _sorted_keys(e),
            lambda order: F.zip_with(
                _starts(order),
                _ends(order),
                lambda s, t: F.struct(s["pos"].alias("first"), t["pos"].alias("last")),
            ),
        )
        return F.transform(F.array_sort(spans), lambda s: F.get(e, s["last"]))

    return _unless_unique(entries, dedupe)
