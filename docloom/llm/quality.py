"""Quality rules as a short-circuit cascade, in DataFrame functions only.

:func:`base_counts` measures texts. A :class:`Rule` is a name and an SQL condition that is true for
text to reject. :func:`estimate_rules` runs each rule over a sample, where it learns what share the
rule rejects and how long it takes; :func:`order_rules` puts the rules in order of rejection per
cost, and :func:`cascade` asks them in that order and stops at the first that rejects. The order decides only how much work is done
and which of several rejecting rules is named, never which rows are kept. All of it is narrow: a
document is one row, however long, and no source or copy group gathers anywhere.

Null text counts as text without words: all counts are 0, and a rule whose condition is null does not
reject. Null and repeated ids are judged row by row; all other columns of the input are carried along
by :func:`cascade` and not looked at by :func:`base_counts`. An empty table stays empty; with nothing
to sample the rules keep their given order.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.tables import stored

SAMPLE_ROWS = 4000
WINDOW = 5
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Runs of characters other than blank and U+0009 to U+000D."""
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def _repeats(docs: DataFrame, words: str) -> DataFrame:
    """Adds ``n_repeat_words``: words inside windows of five words that occur twice or more.

    Windows are told apart by 64-bit hashes within one text. Only texts with an equal pair sort them.
    """
    grams = F.when(
        F.size(words) >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - WINDOW),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    placed = F.when(
        F.size(F.array_distinct("_grams")) < F.size("_grams"),
        F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(a.h == b.h, F.lit(False))

    twice = F.filter(
        "_placed",
        lambda s, k: same(s, F.when(k > 0, F.get("_placed", k - 1))) | same(s, F.get("_placed", k + 1)),
    )
    starts = F.sort_array(F.transform(twice, lambda s: s.i))
    gaps = F.transform("_starts", lambda s, k: F.coalesce(F.least(F.get("_starts", k + 1) - s, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, gap: total + gap)
    return (
        docs.withColumn("_grams", grams)
        .withColumn("_placed", placed)
        .withColumn("_starts", starts)
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint")))
        .drop("_grams", "_placed", "_starts")
    )


def base_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``text``, its ``words`` and ``lines`` (those with a word), and what is counted in
    them: ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines`` (lines
    equal to an earlier one) and ``n_repeat_words``."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    counted = (
        docs.select(F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text"))
        .withColumns({"words": words_of(text), "lines": lines})
        .withColumns(
            {
                "n_words": F.size("words").cast("bigint"),
                "word_chars": F.length(F.translate(text, BLANKS, "")).cast("bigint"),
                "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"),
                "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
            }
        )
    )
    return _repeats(counted, "words")


@dataclass(frozen=True)
class Rule:
    """A name, and an SQL condition over the columns of a table that is true for rows to reject."""

    name: str
    condition: str

    @property
    def rejects(self) -> Column:
        return F.expr(self.condition)


#: Rules over what :func:`base_counts` gives. Their shares leave room above what prose shows: it has
#: next to no such symbols, repeats a third of its lines at most, and hardly ever a word at once.
#: What only one rule needs is worked out inside it, so a row rejected before never pays for it.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "n_repeat_words * 100 > n_words * 20"),
    Rule("symbols", "n_symbols * 10 > n_words * 3"),
    Rule("repeated_lines", "n_dup_lines * 2 > size(lines)"),
    Rule("stutter", "size(filter(words, (w, i) -> i > 0 and w = get(words, greatest(i - 1, 0)))) * 5 > n_words"),
    Rule("capitals", "length(regexp_replace(text, '[^A-Z]+', '')) * 2 > word_chars"),
)
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    rejected: float  # share of the sample
    seconds: float

    @property
    def rank(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def sample_of(docs: DataFrame, key: str = "doc_id", rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of ``key``."""
    share = rows / max(1, docs.count())
    return docs.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)


def estimate_rules(sample: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[Estimate]:
    """Cost and selectivity of each rule on a sample that has the columns the rules read.

    The sample is written once, so that reading it costs each rule the same; the time of a rule is
    that of counting what it rejects, less the time of counting alone.
    """
    sample = stored(sample, "rule-sample")

    def timed(condition: Column) -> tuple[int, int, float]:
        began = time.perf_counter()
        row = sample.agg(F.count(F.lit(1)).alias("n"), F.count_if(condition).alias("hit")).first()
        return row.n, row.hit, time.perf_counter() - began

    timed(F.lit(False))
    rows, _, idle = timed(F.lit(False))
    found = []
    for rule in rules:
        _, hit, spent = timed(F.coalesce(rule.rejects, F.lit(False)))
        found.append(Estimate(rule, hit / max(1, rows), max(spent - idle, 1e-4)))
    return found


def order_rules(estimates: list[Estimate]) -> list[Rule]:
    """Rules by rejection per cost, the best first; ties keep their order."""
    return [e.rule for e in sorted(estimates, key=lambda e: -e.rank)]


def cascade(df: DataFrame, rules: list[Rule] | tuple[Rule, ...], column: str = "rejected_by") -> DataFrame:
    """Adds the name of the first rule that rejects a row, null for rows to keep.

    A conditional expression asks its branches in turn, so later rules cost nothing once one rejects.
    """
    if not rules:
        return df.withColumn(column, F.lit(None).cast("string"))
    chain = F.when(rules[0].rejects, rules[0].name)
    for rule in rules[1:]:
        chain = chain.when(rule.rejects, rule.name)
    return df.withColumn(column, chain)
