"""Query of phrase collocations, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import collocation
from docloom.llm.queries import query
from docloom.llm.tables import read

SQL = """
with pieces as (
  select lang, regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') as ps
  from (select coalesce(lang, 'und') as lang, coalesce(text, '') as text from documents)),
words as (
  select lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda w: w <> '') as ws
  from (select lang, unnest(ps) as p from pieces)),
sizes as (select lang, cast(sum(len(ws)) as bigint) as n from words group by lang),
grams as (
  select lang, size, array_to_string(ws[i:i + size - 1], ' ') as phrase
  from (select lang, ws, size, unnest(generate_series(1, len(ws) - size + 1)) as i
        from words, (select unnest([1, 2, 3, 4, 5]) as size) where len(ws) >= size)),
f as (select lang, size, phrase, string_split(phrase, ' ') as ws, count(*) as a from grams group by all having count(*) >= 100),
inside as (
  select distinct s.lang, s.phrase
  from (select lang, a, array_to_string(ws[i:i + n - 1], ' ') as phrase
        from (select lang, a, ws, n, unnest(generate_series(1, size - n + 1)) as i
              from (select lang, a, ws, size, unnest(generate_series(2, size - 1)) as n from f where size > 2))) g
  join f s on s.lang = g.lang and s.phrase = g.phrase and 100 * g.a >= 100 * s.a),
cuts as (
  select f.lang, f.phrase, f.a, l.a as l, r.a as r, n, k, 1000::hugeint * f.a * n // (l.a::hugeint * r.a) as score
  from (select *, unnest(generate_series(1, size - 1)) as k from f where size > 1) f
  join f l on l.lang = f.lang and l.phrase = array_to_string(f.ws[1:k], ' ')
  join f r on r.lang = f.lang and r.phrase = array_to_string(f.ws[k + 1:], ' ')
  join sizes s on s.lang = f.lang
  where not exists (select 1 from inside i where i.lang = f.lang and i.phrase = f.phrase)),
lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n,
  cast(score as bigint) as score
from lowest qualify rank <= 2000
"""


@query("op11_phrase_collocations", SQL)
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = collocation.mine(read(spark, sf_dir, "documents").select("text", "lang"))
    return collocation.top(phrases).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
