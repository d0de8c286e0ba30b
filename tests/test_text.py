"""Cleaning and extraction against worked cases and against brute force in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import fields, text

CLEAN_CASES = [
    ("Name: Bob", "Name: Bob"),
    ("a\n---\nb", "a\nb"),
    ("a\n--\nb", "a\n--\nb"),
    ("a\n| --- | --- |\nb", "a\n| --- | --- |\nb"),
    ("a\n|---|---|\nb", "a\nb"),
    ("a\n\n\n\n\nb", "a\n\nb"),
    ("a\n\n---\n\nb", "a\n\nb"),
    ("x\x00\x07y\tz", "xy z"),
    ("a b", "a\nb"),
    ("\xa0 pad \xa0\nq", "pad\nq"),
    ("a\r\nb\rc", "a\nb\nc"),
    ("", ""),
    ("   \n\t\n", ""),
    ("a\x0bb\x0cc", "abc"),
]
FIELD_CASES = [
    ("Name: Bob", [("Name", "Bob")]),
    ("**Name:** Bob", [("Name", "** Bob")]),
    ("# - > Total: 5", [("Total", "5")]),
    ("http://x.y/z", [("http", "//x.y/z")]),
    ("ab: short key", []),
    ("Key:", []),
    (": val", []),
    ("Key: a\nKey: b\nkey: c", [("Key", "a"), ("key", "c")]),
    ("Time: 12:30:00", [("Time", "12:30:00")]),
    ("no colon here", []),
    ("Key: " + "v" * 201, []),
    ("Key: " + "v" * 200, [("Key", "v" * 200)]),
    ("k" * 81 + ": v", []),
    ("K" * 80 + ": v", [("K" * 80, "v")]),
    ("ab: x\nKey: " + "v" * 201 + "\nKey: kept", [("Key", "kept")]),
    ("Key\xa0:\xa0value", [("Key", "value")]),
    ("Key: 😀" + "e" * 199, [("Key", "😀" + "e" * 199)]),
]

BLANK = set("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0     　") | {
    chr(c) for c in range(0x2000, 0x200B)
}


def _trim(s, drop=BLANK):
    while s and s[0] in drop:
        s = s[1:]
    while s and s[-1] in drop:
        s = s[:-1]
    return s


def slow_clean(s):
    """Character by character, line by line."""
    kept = [c for c in s if not ((ord(c) < 32 and c not in "\t\n\r") or ord(c) == 127)]
    out = []
    for c in kept:
        if c in " \t":
            if out and out[-1] == " ":
                continue
            c = " "
        out.append(c)
    lines, line, i = [], "", 0
    while i < len(out):
        if out[i] == "\r" and out[i + 1 : i + 2] == ["\n"]:
            i += 1
        if out[i] in "\n\r\x85  ":
            lines.append(line)
            line = ""
        else:
            line += out[i]
        i += 1
    lines.append(line)
    kept_lines = []
    for line in map(_trim, lines):
        if len(line) >= 3 and set(line) <= set("-=_*|#"):
            continue
        if line == "" and kept_lines[-1:] == [""]:
            continue
        kept_lines.append(line)
    return _trim("\n".join(kept_lines))


def slow_fields(cleaned):
    found, seen = [], set()
    for line in cleaned.split("\n"):
        line = _trim(line)
        while line and line[0] in "#*-> ":
            line = line[1:]
        line = _trim(line)
        at = line.find(":")
        if at < 0 or len(line) > 300:
            continue
        key, value = _trim(line[:at]), _trim(line[at + 1 :])
        if 3 <= len(key) <= 80 and 1 <= len(value) <= 200 and key not in seen:
            seen.add(key)
            found.append((key, value))
    return found


def random_texts(n, seed):
    rng = random.Random(seed)
    pieces = (
        list("ab:-=_*|# \t\n\r>\x00\x07\x0b\x0c\x1c\x1f\x7f\x85\xa0   　é😀")
        + ["Key: v\n", "Key : w\n", "---\n", "|---|\n", "\r\n", "\n\n\n", "Total: ", "  ", "::"]
        + ["x" * 79, "y" * 199, "z" * 290]
    )
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(n)]


def run(spark, texts, expression):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8)
    return [r[1] for r in sorted(df.select("i", expression(F.col("text"))).collect())]


def test_clean_cases(spark):
    assert run(spark, [c[0] for c in CLEAN_CASES], text.clean_text) == [c[1] for c in CLEAN_CASES]


def test_field_cases(spark):
    got = run(spark, [c[0] for c in FIELD_CASES], fields.extract_fields)
    assert [[tuple(f) for f in row] for row in got] == [c[1] for c in FIELD_CASES]


def test_strip_set_has_all_blanks():
    assert len(text.STRIP_CHARS) == 29
    assert set(text.STRIP_CHARS) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    texts = random_texts(3000, seed)
    cleaned = run(spark, texts, text.clean_text)
    assert cleaned == [slow_clean(t) for t in texts]
    got = run(spark, texts, lambda c: fields.extract_fields(text.clean_text(c)))
    assert [[tuple(f) for f in row] for row in got] == [slow_fields(c) for c in cleaned]


def test_clean_properties(spark):
    texts = random_texts(2000, 7)
    cleaned = run(spark, texts, text.clean_text)
    assert run(spark, cleaned, text.clean_text) == cleaned
    for c in cleaned:
        assert "\n\n\n" not in c
        assert not any(ord(x) < 32 and x != "\n" for x in c)
        for line in c.split("\n"):
            assert not (len(line) >= 3 and set(line) <= set("-=_*|#"))


def test_null_text_stays_null(spark):
    row = spark.sql("select cast(null as string) as text").select(
        text.clean_text(F.col("text")), fields.extract_fields(F.col("text"))
    ).first()
    assert tuple(row) == (None, None)


def test_one_document_with_very_many_lines(spark):
    """Half a million lines, half of them one key: the first of each key, in order."""
    n = 250_000
    body = F.concat_ws(
        "\n",
        F.transform(
            F.sequence(F.lit(1), F.lit(n)),
            lambda i: F.concat(F.lit("Same: "), i.cast("string"), F.lit("\nKey "), i.cast("string"), F.lit(": x")),
        ),
    )
    found = spark.range(1).select(fields.extract_fields(text.clean_text(body)).alias("f"))
    row = found.select(
        F.size("f").alias("n"), F.col("f")[0].alias("a"), F.col("f")[1].alias("b"), F.col("f")[n].alias("z")
    ).first()
    assert (row.n, tuple(row.a), tuple(row.b), tuple(row.z)) == (
        n + 1,
        ("Same", "1"),
        ("Key 1", "x"),
        (f"Key {n}", "x"),
    )


def test_map_keeps_order_and_empty(spark):
    df = spark.createDataFrame([("Zed: 1\nAbc: 2",), ("none",)], "text string")
    rows = df.select(fields.fields_map(fields.extract_fields(F.col("text"))).alias("m")).collect()
    assert [list(r.m.items()) for r in rows] == [[("Zed", "1"), ("Abc", "2")], []]
