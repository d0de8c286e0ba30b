"""Text cleaning as column expressions: no Python per row, no shuffle.

Whole cleaning, in order: delete control characters, collapse blanks, split into lines, trim each
line, drop rule lines, join, collapse runs of line feeds, trim the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.arrays import change_where, let

# The 29 characters that count as blank at the ends of a line.
STRIP_CHARS = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x20), 0x20, 0x85, 0xA0, 0x1680]
        + [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)

# Control characters that are deleted (all but tab, LF, CR), and the rule patterns.
CONTROL_CODES = [*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F]
BLANKS = r"[ \t]+"
RULE_LINE = r"^[-=_*|#]{3,}\z"
LINE_FEEDS = r"\n{3,}"
LINE_BREAK = r"\r\n|[\n\r\x85\u2028\u2029]"

# One by one, not as ranges: Java looks single characters up in a bit set.
CONTROL = "[" + "".join(rf"\x{code:02x}" for code in CONTROL_CODES) + "]"
BREAKS_BUT_LF = "\r\x85\u2028\u2029"


def _has_any(text: Column, parts: str | tuple[str, ...]) -> Column:
    """Byte search, an order of magnitude cheaper than a pattern that then finds nothing."""
    found = [F.contains(text, F.lit(part)) for part in parts]
    return reduce(Column.__or__, found)


def strip(text: Column) -> Column:
    """Trim all of :data:`STRIP_CHARS`; plain ``trim`` takes off U+0020 only."""
    return F.btrim(text, F.lit(STRIP_CHARS))


def strip_control(text: Column) -> Column:
    """Delete control characters, keeping tab, LF and CR. Nothing is put in their place."""
    return F.regexp_replace(text, CONTROL, "")


def collapse_blanks(text: Column) -> Column:
    """One space for every run of spaces and tabs; other Unicode blanks stay."""
    return change_where(
        text, lambda t: _has_any(t, ("  ", "\t")), lambda t: F.regexp_replace(t, BLANKS, " ")
    )


def split_lines(text: Column) -> Column:
    """Split a text without control characters at every line break that it may hold.

    A final break leaves a last empty line. VT, FF and the separators x1c to x1e would break lines
    too; T1 deletes them first.
    """
    return let(
        text,
        lambda t: F.when(_has_any(t, BREAKS_BUT_LF), F.split(t, LINE_BREAK)).otherwise(
            F.split(t, "\n")
        ),
    )


def collapse_line_feeds(text: Column) -> Column:
    """At most two line feeds in a row."""
    return change_where(
        text,
        lambda t: F.contains(t, F.lit("\n\n\n")),
        lambda t: F.regexp_replace(t, LINE_FEEDS, "\n\n"),
    )


def doc_lines(text: Column) -> Column:
    """The trimmed lines of a text."""
    return F.transform(split_lines(collapse_blanks(strip_control(text))), strip)


def is_rule_line(line: Column) -> Column:
    """T5: a trimmed line of three or more rule characters. ``| --- |`` has blanks and stays."""
    return line.rlike(RULE_LINE)


def clean_text(text: Column) -> Column:
    """T1-T7. Line feeds are collapsed after rule lines go, so the gaps these leave close up."""
    kept = F.filter(doc_lines(text), lambda line: ~is_rule_line(line))
    return strip(collapse_line_feeds(F.array_join(kept, "\n")))
