"""Rule-based ``key: value`` extraction from cleaned text, inside one row per document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.arrays import first_per_key
from docloom.functions.text import strip

# Decoration taken off the head of a line, and the length bounds.
DECORATION = "#*-> "
MAX_LINE = 300
KEY_LENGTH = (3, 80)
VALUE_LENGTH = (1, 200)


def undecorated(line: Column) -> Column:
    """K2: trim, take any mix of decoration characters off the head, trim again."""
    return strip(F.ltrim(strip(line), F.lit(DECORATION)))


def is_candidate(line: Column) -> Column:
    """K3: an undecorated line with a colon and at most 300 characters."""
    return F.contains(line, F.lit(":")) & (F.length(line) <= MAX_LINE)


def split_field(line: Column) -> Column:
    """K4: ``struct<key, value>`` cut at the first colon."""
    return F.struct(
        strip(F.substring_index(line, ":", 1)).alias("key"),
        strip(F.substr(line, F.locate(":", line) + 1)).alias("value"),
    )


def in_bounds(field: Column) -> Column:
    """K5: key and value lengths in characters."""
    return F.length(field["key"]).between(*KEY_LENGTH) & F.length(field["value"]).between(
        *VALUE_LENGTH
    )


def text_lines(cleaned: Column) -> Column:
    """K1: the lines of a cleaned text, which breaks at LF only."""
    return F.split(cleaned, "\n")


def extract_fields(cleaned: Column) -> Column:
    """K1-K6: ``array<struct<key, value>>`` in text order, first occurrence of a key only.

    A line out of bounds does not claim its key. Repeats are dropped within the row, so no
    document, however many lines it has, sends rows through a shuffle.
    """
    with_colon = F.filter(text_lines(cleaned), lambda line: F.contains(line, F.lit(":")))
    candidates = F.filter(F.transform(with_colon, undecorated), is_candidate)
    return first_per_key(F.filter(F.transform(candidates, split_field), in_bounds))


def fields_map(fields: Column) -> Column:
    """K7: ordered map of the fields; an empty map when there are none."""
    return F.map_from_entries(fields)
