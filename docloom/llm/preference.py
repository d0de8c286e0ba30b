"""Chat formatting of preference pairs.

A pair is two conversations, one chosen and one rejected. Their longest common beginning, in whole
turns of equal role and text, is rendered once as the prompt; what follows it on either side is that
side's completion. With a completion come the spans of its characters to learn from: the text of
assistant turns and the end mark behind it. Headers and all other turns are masked.

Turns of a side are in order of turn, then role, then text, and repeated rows are turns of their own. A
null role is rendered as an empty one and a null text as an empty one, but they equal only nulls. A null
pair id is an id like others. A pair with one side only has an empty prompt and an empty completion on
the other side; two equal sides are all prompt. Other columns are not looked at. Empty tables give no
rows. One pair is one record: its turns are gathered in one row, those of different pairs never.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"
END = "\n"


def header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn.role, F.lit("")), F.lit("|>\n"))


def body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn.text, F.lit("")), F.lit(END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t), body(t))), "")


def trained_spans(turns: Column) -> Column:
    """Spans [begin, end) of characters of the rendered turns that are learned from."""
    none = F.array().cast("array<struct<begin:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(done: Column, turn: Column) -> Column:
        begin = done.at + F.length(header(turn))
        end = begin + F.length(body(turn))
        span = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        trained = F.coalesce(turn.role == TRAINED_ROLE, F.lit(False))
        return F.struct(
            end.alias("at"), F.when(trained, F.concat(done.spans, span)).otherwise(done.spans).alias("spans")
        )

    return F.aggregate(turns, start, step, lambda done: done.spans)


def _numbered(turns: DataFrame, side: str, pair_column: str) -> DataFrame:
    order = Window.partitionBy("pair_id").orderBy("turn", "role", "text")
    return turns.select(F.col(pair_column).alias("pair_id"), "turn", "role", "text").select(
        "pair_id",
        F.row_number().over(order).alias("place"),
        F.lit(side).alias("side"),
        F.struct("role", "text").alias("said"),
    )


def format_pairs(chosen: DataFrame, rejected: DataFrame, pair_column: str = "pair_id") -> DataFrame:
    """From ``chosen`` and ``rejected``, each with a pair id, ``turn, role, text``: ``pair_id``,
    ``n_prompt_turns``, ``prompt``, ``chosen``, ``rejected``, ``chosen_spans`` and ``rejected_spans``."""
    turns = _numbered(chosen, "chosen", pair_column).unionByName(_numbered(rejected, "rejected", pair_column))
    said = {s: F.first(F.when(F.col("side") == s, F.col("said")), ignorenulls=True).alias(s) for s in ("chosen", "rejected")}
    places = turns.groupBy("pair_id", "place").agg(*said.values())
    pairs = places.groupBy("pair_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "chosen", "rejected"))).alias("turns")
    )
    different = F.filter("turns", lambda t: ~t.chosen.eqNullSafe(t.rejected))
    first = F.coalesce(F.get(different, 0).place, F.size("turns") + 1)
    pairs = pairs.withColumn("n_prompt_turns", first - 1)

    def rest(side: str) -> Column:
        some = F.filter("turns", lambda t: (t.place > F.col("n_prompt_turns")) & t[side].isNotNull())
        return F.transform(some, lambda t: t[side])

    prompt = F.transform(F.slice("turns", F.lit(1), F.col("n_prompt_turns")), lambda t: t.chosen)
    return pairs.select(
        "pair_id",
        F.col("n_prompt_turns").cast("bigint").alias("n_prompt_turns"),
        rendered(prompt).alias("prompt"),
        *[rendered(rest(s)).alias(s) for s in said],
        *[trained_spans(rest(s)).alias(f"{s}_spans") for s in said],
    )
