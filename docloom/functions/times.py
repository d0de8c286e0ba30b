"""Time arithmetic that does not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.rounding import round_binary

_MICROS = 1_000_000


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 for a timestamp (with or without zone) or an epoch-second column."""
    kind, col = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, T.TimestampNTZType):
        span = col - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
        whole = (
            F.extract(F.lit("DAY"), span).cast("bigint") * 86400
            + F.extract(F.lit("HOUR"), span) * 3600
            + F.extract(F.lit("MINUTE"), span) * 60
        )
        micros = (F.extract(F.lit("SECOND"), span) * _MICROS).cast("bigint")
        return whole * _MICROS + micros
    return F.round(col * _MICROS).cast("bigint")


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds with two decimals between two microsecond columns."""
    return round_binary((end - start) / _MICROS, 2)
