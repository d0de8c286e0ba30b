import random

import pytest
from pyspark.sql import functions as F

from docloom.llm import decontamination as D


def brute(items, words, window):
    hit, names = set(), set()
    for item, text in items:
        own = D.words_of(text)
        n = min(window, len(own))
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1):
            if grams and tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                names.add(item)
    return hit, names


def test_automaton_against_brute_force():
    rng = random.Random(2)
    for _ in range(1500):
        window, letters = rng.choice([1, 2, 3, 4]), "abc"[: rng.choice([1, 2, 3])]
        items = [(str(i), " ".join(rng.choice(letters) for _ in range(rng.randint(0, 8)))) for i in range(rng.randint(0, 5))]
        words = D.words_of(" ".join(rng.choice(letters + "d") for _ in range(rng.randint(0, 25))))
        spans, names = D.Automaton.of(items, window).scan(words)
        hit, want = brute(items, words, window)
        assert ({x for a, b in spans for x in range(a, b)}, names) == (hit, want)
        assert spans == D.merged(spans)


PASSAGE = " ".join(f"w{i}" for i in range(30))


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, PASSAGE), (2, "short Item"), (None, "null id words here"), (3, None), (4, " ,. "), (1, PASSAGE)]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("slice_words", [D.SLICE_WORDS, 3])
def test_find(spark, bench, slice_words):
    texts = [f"before {PASSAGE.upper()} after", "a SHORT, item!", None, "", "nothing here", " ".join(PASSAGE.split()[:9]), "null id words here"]
    docs = spark.createDataFrame(list(enumerate(texts)) * 2, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as n_words")
    found = D.find(docs, bench, slice_words=slice_words).collect()
    got = {r.doc_id: (r.found.n_words, r.found.n_hit, list(r.found["items"])) for r in found}
    assert len(found) == 14
    assert got == {0: (32, 30, ["1"]), 1: (3, 2, ["2"]), 2: (0, 0, []), 3: (0, 0, []), 4: (2, 0, []), 5: (9, 0, []), 6: (4, 4, [])}


def test_decontaminate(spark, bench):
    words = PASSAGE.split()
    clean = " ".join(f"c{i}" for i in range(60))
    nested = f"{clean} {' '.join(words[:6])} {PASSAGE} {' '.join(words[6:12])} end"
    shouted = f"{clean.upper()} É-x. {PASSAGE.upper()}! REST, Stays."
    texts = {0: f"{clean}. {PASSAGE}! Rest, stays.", 6: shouted, 1: PASSAGE, 2: clean, 3: None, 4: nested, 5: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("_x", F.lit(1))
    got = {r.doc_id: r.text for r in D.decontaminate(docs, bench).collect()}
    assert got.pop(6) == f"{clean.upper()} É-x. ! REST, Stays."
    assert set(got) == {0, 2, 3, 4, 5} and got[2] == clean and got[3] is None and got[5] == ""
    assert got[0] == f"{clean}. ! Rest, stays." and got[4].split() == [*clean.split(), "end"]
    assert D.decontaminate(docs, bench).columns == docs.columns


def test_words_of_texts_stand_where_they_are_found():
    rng = random.Random(4)
    for _ in range(500):
        text = "".join(rng.choice("aZ0 .,@[`{é😀\n_") for _ in range(rng.randint(0, 40)))
        assert [m.group().encode().translate(D._TABLE) for m in D._WORD.finditer(text)] == D.words_of(text)


def test_empty_tables(spark, bench):
    docs = spark.createDataFrame([(1, PASSAGE)], "doc_id long, text string")
    assert D.find(docs, bench.limit(0)).first().found.n_hit == 0
    assert D.find(docs.limit(0), bench).count() == 0 and D.decontaminate(docs.limit(0), bench).count() == 0
