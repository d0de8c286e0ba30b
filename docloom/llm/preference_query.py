"""Query of chat formatting, and its SQL.

``conversations`` has no rejected side, so one is made: the conversation up to its last answer is the
chosen one, and in the rejected one that answer is replaced by the conversation's first answer, or by an
empty one if it has no other. Conversations without an answer have nothing to prefer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import preference
from docloom.llm.queries import query
from docloom.llm.tables import read

_RENDER = "'<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10)"

SQL = f"""
with answers as (
  select conv_id, min(turn) as first_turn, max(turn) as last_turn from conversations
  where role = 'assistant' group by conv_id),
firsts as (
  select conv_id, text as first_text from conversations join answers using (conv_id) where turn = first_turn),
chosen as (select c.conv_id, turn, role, text from conversations c join answers using (conv_id) where turn <= last_turn),
rejected as (
  select c.conv_id, turn, role,
    case when turn < last_turn then text when first_turn < last_turn then first_text else '' end as text
  from chosen c join answers using (conv_id) join firsts using (conv_id)),
both_sides as (
  select c.conv_id, c.turn, c.role, c.text, r.text as other
  from chosen c join rejected r on c.conv_id = r.conv_id and c.turn = r.turn),
diff as (select conv_id, min(turn) as turn from both_sides where text is distinct from other group by conv_id),
prompts as (
  select b.conv_id, count(*) as n, string_agg({_RENDER}, '' order by b.turn) as prompt
  from both_sides b left join diff d using (conv_id) where d.turn is null or b.turn < d.turn group by b.conv_id),
rest as (
  select a.conv_id, {_RENDER.replace("role", "b.role").replace("text", "b.text")} as chosen,
    {_RENDER.replace("role", "b.role").replace("text", "b.other")} as rejected
  from answers a join diff d using (conv_id) join both_sides b on b.conv_id = a.conv_id and b.turn = d.turn)
select a.conv_id, coalesce(p.n, 0) as n_prompt_turns, coalesce(p.prompt, '') as prompt,
  coalesce(r.chosen, '') as chosen, coalesce(r.rejected, '') as rejected,
  case when r.conv_id is null then '' else '14-' || length(r.chosen) end as chosen_spans,
  case when r.conv_id is null then '' else '14-' || length(r.rejected) end as rejected_spans
from answers a left join prompts p using (conv_id) left join rest r using (conv_id)
"""


def _text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s.begin.cast("string"), F.lit("-"), s.end.cast("string"))), ",")


@query("op9_chat_formatting", SQL)
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    answer = F.col("role") == preference.TRAINED_ROLE
    # a conversation's first and last answer, folded before anything moves
    answers = (
        turns.filter(answer)
        .groupBy("conv_id")
        .agg(
            F.min("turn").alias("first_turn"),
            F.max("turn").alias("last_turn"),
            F.min_by("text", "turn").alias("first_text"),
        )
    )
    chosen = turns.join(answers, "conv_id").filter(F.col("turn") <= F.col("last_turn"))
    last = F.when(F.col("first_turn") < F.col("last_turn"), F.col("first_text")).otherwise("")
    rejected = chosen.withColumn("text", F.when(F.col("turn") < F.col("last_turn"), F.col("text")).otherwise(last))
    pairs = preference.format_pairs(chosen, rejected, "conv_id")
    return pairs.select(
        F.col("pair_id").alias("conv_id"),
        "n_prompt_turns",
        "prompt",
        "chosen",
        "rejected",
        _text("chosen_spans").alias("chosen_spans"),
        _text("rejected_spans").alias("rejected_spans"),
    )
