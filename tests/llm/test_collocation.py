import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.llm import collocation

UPPER = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(rows, max_words=5, min_count=3, keep=100, top=2000):
    """All phrases by counting each occurrence."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\\x0a-\\x0d]", (text or "").translate(UPPER)):
            words = re.findall("[^\\x20\\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, max_words + 1):
                    if i + k <= len(words):
                        f[lang, tuple(words[i : i + k])] += 1
    found = {p: a for p, a in f.items() if a >= min_count and len(p[1]) > 1}
    inside = set()
    for (lang, ws), a in found.items():
        for size in range(2, len(ws)):
            for i in range(len(ws) - size + 1):
                part = lang, ws[i : i + size]
                if 100 * a >= keep * found[part]:
                    inside.add(part)
    out = []
    for lang in n:
        mine = []
        for (of, ws), a in found.items():
            if of == lang and (of, ws) not in inside:
                cuts = [(1000 * a * n[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws))]
                score, k = min(cuts)
                mine.append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(mine)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def made(seed, count=60):
    rng = random.Random(seed)
    words = ["a", "b", "B", "cc", "\u00e9", "\u00c9", "d\u00a0d", "e\x1c", "\x85", "f" * 300]
    marks = [" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\r\n", "\x0b", " \x0c", "!", "?;:"]
    rows = []
    for _ in range(count):
        text = "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.choice([0, 1, 3, 30, 200])))
        rows.append((text, rng.choice(["en", "en", "en", "de", None, "und"])))
    return rows + [rows[0]] * 5 + [(None, "en"), ("", None), (" a b", "en"), ("a b a b a b a b", "x")]


@pytest.mark.parametrize(
    ("block", "size", "least", "keep", "small"),
    [(1 << 19, 5, 3, 100, 1000), (7, 5, 3, 100, 1000), (7, 5, 3, 100, 0), (1, 3, 2, 80, 20), (50, 2, 1, 50, 1000)],
)
def test_phrases_are_those_of_counting(spark, block, size, least, keep, small, monkeypatch):
    monkeypatch.setattr(collocation, "PART_BYTES", 40 if block < 100 else 1 << 20)
    monkeypatch.setattr(collocation, "COUNTED_WORDS", 5)
    rows = made(block)
    docs = spark.createDataFrame([(t, g, 1, 2) for t, g in rows], "text string, lang string, word long, block long")
    found = collocation.mine(docs, max_words=size, min_count=least, keep_share=keep, block_words=block, broadcast_phrases=small)
    got = collocation.top(found, 20)
    got = sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute(rows, size, least, keep, 20) and len(got) > 10


def test_scores_past_64_bits_are_exact(spark):
    big = 3_000_000_000_000
    got = spark.createDataFrame([(big, 7 * big, big + 1, 3 * big + 2)], "a long, n long, l long, r long").select(
        collocation._score(*map(F.col, "anlr"))
    )
    assert got.first()[0] == 1000 * big * 7 * big // ((big + 1) * (3 * big + 2))


def test_empty_tables_and_no_words(spark):
    for rows in ([], [(None, None)], [("...", "en")]):
        docs = spark.createDataFrame(rows, "text string, lang string")
        assert collocation.top(collocation.mine(docs)).collect() == []


def test_occurrences_stay_in_their_blocks(spark):
    """A relation's row is one of its block; what is counted is one number for each distinct phrase of a block."""
    docs = spark.createDataFrame([("en", b"a b " * 1000)] * 4, "lang string, text binary").coalesce(1)
    words = docs.sparkSession.createDataFrame([("en", b"a", 7), ("en", b"b", 8)], "lang string, word binary, id long")
    relations = [collocation.word_relation(docs, words, 1 << 19, 5, small).collect() for small in (True, False)]
    assert relations[0] == relations[1] and len(relations[0]) == 1
    assert list(collocation._unpacked(relations[0][0].ids)) == [7, 8]
    assert len(collocation._unpacked(relations[0][0].phrases)) == 8000
    relation = collocation.word_relation(docs, words, 1 << 19, 5, True)
    pairs = sorted((r.front, r.back, r.a) for r in collocation.pair_counts(relation, 3, 100).collect())
    assert pairs == [(7, 8, 4000), (8, 7, 3996)]
