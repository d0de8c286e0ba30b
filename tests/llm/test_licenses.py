import random
import re

import pytest

from docloom.llm import licenses as L


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(text, phrases):
    words, found = words_of(text), []
    for t in phrases:
        p = t.words.split()
        found += [(i, t.label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    places = sorted(i for i, _ in found)
    return len(words), len(places), places[0] if places else None, places[-1] if places else None, sorted({n for _, n in found})


def test_places_against_brute_force(spark):
    rng = random.Random(13)
    some = "cc by general public license all rights reserved the CC-BY General! é".split()
    texts = [" ".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += [None, "", "cc", "cc by", "cc by cc by cc by", "all rights reserved " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as label", "2 as score")
    for limit in (L.BROADCAST_PAIRS, 0):
        rows = L.scan(docs, L.PHRASES, broadcast_pairs=limit).collect()
        got = {r.doc_id: (r.n_words, r.places, r.first, r["last"], list(r.exact_labels)) for r in rows}
        assert got == {i: brute(t, L.PHRASES) for i, t in enumerate(texts)}


def test_changed_notices_are_found_and_others_not(spark):
    cases = {
        "Licensed under the Apache License, Version 2.0": {"apache-2.0"},
        "licensed under the very apache license version 2 0": {"apache-2.0"},
        "Released under the MIT license": {"mit"},
        "under the license the apache version licensed": set(),
        "this work is licensed under the gnu general public license version 3": {"gpl", "gpl-3.0"},
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    rows = {r.doc_id: r for r in L.scan(docs).collect()}
    assert [set(rows[i].labels) for i in range(len(cases))] == list(cases.values())
    assert rows[3].score == 0 and rows[0].score == 1 and 0.75 <= rows[1].score < 1
    assert rows[1].spans[0].begin == 0 and rows[1].spans[0].end == 9


def test_repeated_null_and_empty(spark):
    rows = [(1, "cc by"), (1, "cc by"), (1, "x"), (None, "cc by"), (None, "cc by"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.places, ",".join(r.labels)) for r in L.scan(docs).collect())
    assert got == [(-1, 1, "cc-by"), (-1, 1, "cc-by"), (1, 0, ""), (1, 1, "cc-by"), (1, 1, "cc-by"), (2, 0, "")]
    assert L.scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        L.scan(docs, (L.Template("one", "word"),))
