"""Document tables in array form and in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import grids
from docloom.operators.layout import explode_rows


def nonempty_tables(docs: DataFrame) -> DataFrame:
    """G1: one row per table that has rows: ``(doc_id, table_idx, n_rows)``, indexes from 1."""
    tables = explode_rows(docs, ["doc_id"], grids.nonempty(F.col("tables")), "table_idx", "t")
    return tables.select("doc_id", "table_idx", F.size("t").alias("n_rows"))


def cells(docs: DataFrame) -> DataFrame:
    """One row per cell: ``(doc_id, table_idx, row_idx, col_idx, cell)``; ragged rows are fine."""
    tables = explode_rows(docs, ["doc_id"], grids.nonempty(F.col("tables")), "table_idx", "t")
    rows = explode_rows(tables, ["doc_id", "table_idx"], "t", "row_idx", "r")
    return explode_rows(rows, ["doc_id", "table_idx", "row_idx"], "r", "col_idx", "cell")


def preview_rows(rows: DataFrame, table_keys: list[str], order: list) -> DataFrame:
    """G3 in long form: the first rows of each table, with ``row_idx`` and ``is_header``.

    The limit on ``row_number`` also runs before the shuffle (WindowGroupLimit), so each map task
    sends at most the preview of a table on, however many rows the table has.
    """
    w = Window.partitionBy(*table_keys).orderBy(*order)
    return (
        rows.withColumn("row_idx", F.row_number().over(w))
        .filter(F.col("row_idx") <= grids.PREVIEW_ROWS)
        .withColumn("is_header", F.col("row_idx") == 1)
    )
