"""Pieces of check SQL (DuckDB): cleaning and extraction written a second time, as SQL.

Each piece is one or more common table expressions; :func:`steps` joins them to a query.
"""

from __future__ import annotations

BLANKS = (
    "concat("
    + ", ".join(
        f"chr({c})"
        for c in [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760]
        + list(range(8192, 8203))
        + [8232, 8233, 8239, 8287, 12288]
    )
    + ")"
)
# The patterns of the functions, in this engine's notation.
CONTROL = r"'[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]'"
BREAK = r"'\r\n|[\n\r\x{85}\x{2028}\x{2029}]'"
RULE = "'^[-=_*|#]{3,}$'"


def trim(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def no_control(x: str) -> str:
    return f"regexp_replace({x}, {CONTROL}, '', 'g')"


def one_blank(x: str) -> str:
    return f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"


def lines_of(x: str) -> str:
    pieces = f"string_split_regex({one_blank(no_control(x))}, {BREAK})"
    return f"list_transform({pieces}, lambda l: {trim('l')})"


def cleaned_of(x: str) -> str:
    kept = f"list_filter({lines_of(x)}, lambda l: not regexp_matches(l, {RULE}))"
    joined = f"regexp_replace(array_to_string({kept}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return trim(joined)


def cleaned(source: str, keys: str) -> str:
    """``cleaned``: keys, text, cleaned_text."""
    return f"cleaned as (select {keys}, text, {cleaned_of('text')} as cleaned_text from {source})"


def split_lines(keys: str) -> str:
    """``lines``: keys, line_no, undecorated line of the cleaned text."""
    undecorated = trim(f"ltrim({trim('raw')}, '#*-> ')")
    return f"""pieces as (select {keys}, unnest(string_split(cleaned_text, chr(10))) as raw,
  generate_subscripts(string_split(cleaned_text, chr(10)), 1) as line_no from cleaned),
lines as (select {keys}, line_no, {undecorated} as line from pieces)"""


def kv(keys: str) -> str:
    """``kv``: keys, field_no, key, val; one row per field."""
    return f"""split as (select {keys}, line_no, {trim("split_part(line, ':', 1)")} as key,
  {trim("substr(line, instr(line, ':') + 1)")} as val
  from lines where contains(line, ':') and length(line) <= 300),
firsts as (select {keys}, key, arg_min(val, line_no) as val, min(line_no) as line_no from split
  where length(key) between 3 and 80 and length(val) between 1 and 200 group by all),
kv as (select {keys}, cast(row_number() over (partition by {keys} order by line_no) as int) as field_no,
  key, val from firsts)"""


def kv_steps(source: str, keys: str) -> str:
    return ",\n".join([cleaned(source, keys), split_lines(keys), kv(keys)])


def steps(*parts: str, select: str) -> str:
    return "with " + ",\n".join(parts) + "\n" + select


# ``entries``: doc_id, key, val, is_blank per field of the model responses; ``ai``: counts per doc.
MODEL = """found as (select doc_id, regexp_extract(response, '\\{.*\\}') as body from llm),
objects_ok as (select doc_id, body::json as body from found where body <> '' and json_valid(body)),
keyed as (select doc_id, body, unnest(json_keys(body)) as key from objects_ok),
entries as (select doc_id, key, json_extract(body, '$."' || key || '"') as raw,
  json_extract_string(body, '$."' || key || '"') as val from keyed),
flagged as (select doc_id, key, val,
  json_type(raw) = 'NULL' or raw::varchar in ('""', '[]', '{}') as is_blank from entries),
ai as (select doc_id, count(*) as ai_fields, count(*) filter (not is_blank) as kept from flagged group by doc_id)"""



def round_binary(x: str, digits: int) -> str:
    """Rounding by exact binary value, ties to even, of a double expression."""
    unit, powers = {1: (10, (16, 4)), 2: (100, (128, 64, 8))}[digits]
    size, n = f"abs({x})", f"cast(round(abs({x}) * {2 * unit}) as bigint)"
    rest = f"({size} * {powers[0]} - {n}" + "".join(f" + {size} * {p}" for p in powers[1:]) + ")"
    down = f"{rest} < 0 or ({rest} = 0 and ({n} // 2) % 2 = 0)"
    at_tie = f"sign({x}) * (case when {down} then {n} // 2 else {n} // 2 + 1 end) / {unit}.0"
    return f"case when {n} % 2 = 1 and {size} = {n} / {2 * unit}.0 then {at_tie} else round({x}, {digits}) end"


SCORE = f"""scored as (select doc_id, c, {round_binary('c * 100', 1)} as score
  from (select doc_id, coalesce(confidence, 1.0) as c from conf) p)"""
