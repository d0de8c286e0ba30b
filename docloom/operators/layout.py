"""Row layout: spreading rows on request, and exploding without computing the input twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, partitions: int | None, *keys: str) -> DataFrame:
    """Hash rows over ``partitions`` tasks by unique ``keys``; without a number, ``df`` as it is.

    For tables in fewer files or row groups than there are task slots. A hash needs no sort to be
    repeatable.
    """
    return df if partitions is None else df.repartition(partitions, *keys)


def explode_rows(df: DataFrame, keys: list[str], array: str | Column, number: str, item: str) -> DataFrame:
    """``keys``, ``number`` from 1 and ``item`` for each element of ``array``.

    An inner explode of a computed column makes the optimizer add a filter on its size, which
    computes the column a second time. The outer form does not, so empty arrays go out here.
    """
    rows = df.select(*keys, F.posexplode_outer(array).alias("explode_pos", item))
    kept = rows.filter(F.col("explode_pos").isNotNull())
    return kept.select(*keys, (F.col("explode_pos") + 1).alias(number), item)
