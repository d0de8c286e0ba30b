import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from docloom.llm import alignment


@pytest.fixture(scope="module")
def both():
    return alignment.Aligner(*alignment.vocabulary_paths())


def tokens(both, text):
    """Ids and byte ends of both tokenizers, or nothing."""
    if not text:
        return None
    out = []
    for of, ids in (
        (both.a, both.a.slow.encode(" " + text, add_special_tokens=False).ids),
        (both.b, both.b.model.encode(text)),
    ):
        if b"".join(of.bytes[i] for i in ids) != (" " + text).encode():
            return None
        out.append((ids, np.cumsum([len(of.bytes[i]) for i in ids]).tolist()))
    return out


def brute(both, text):
    """Counts, form and links of a text, by comparing all ends."""
    got = tokens(both, text)
    if got is None:
        return 0, 0, "", []
    (a, ends_a), (b, ends_b) = got
    forms, links, i, j = [], [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        to_a, to_b = ends_a.index(end) + 1, ends_b.index(end) + 1
        forms.append(",".join(map(str, a[i:to_a])) + "|" + ",".join(map(str, b[j:to_b])))
        i, j = to_a, to_b
    links = [(x, y) for x, e in zip(a, ends_a, strict=True) for y, g in zip(b, ends_b, strict=True) if e == g]
    return len(a), len(b), ";".join(forms), links


def texts():
    rng = random.Random(7)
    letters = "aeé\u00c9ßzxthing    \n\t\r\x0b\x00\u00a0\u3000\u65e5\u672c\uac00\U0001f600's't.,!?019\u2167\u00b2\u0301"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    out += ["<s> a</s>", "<|endoftext|> <0x41>", "\u2581a b", " ", "   ", "\n\n", " lead", "a" * 3000, " " * 3000 + "x", "x" * 30000]
    return out + ["the same text, twice"] * 2 + ["", None]


def test_vocabularies_spell_their_tokens(both):
    assert all(both.a.bytes) and [i for i, w in enumerate(both.b.bytes) if not w] == [0, 1, 2]
    assert len(both.universe) <= sum(map(len, both.a.bytes)) + 2 * sum(map(len, both.b.bytes))


def test_texts_align_as_by_comparing_all_ends(both, monkeypatch):
    rows = texts()
    want = [brute(both, t) for t in rows]
    assert sum(not w[2] for w in want) < 80
    for known in (alignment.KNOWN_WINDOWS, 3):
        monkeypatch.setattr(alignment, "KNOWN_WINDOWS", known)
        for _ in range(2):  # remembered windows, too
            got = both.align(rows)
            for w, g in zip(want, got, strict=True):
                if g is None:
                    assert w == (0, 0, "", [])
                else:
                    codes = np.frombuffer(g[2], "<u4").tolist()
                    assert (g[0], g[1], g[3].decode()) == w[:3]
                    assert sorted(codes) == sorted(x * both.size + y for x, y in w[3])
                    assert set(codes) <= set(both.universe[np.searchsorted(both.universe, codes)].tolist())


def test_strengths_are_those_of_all_links(spark, both):
    rows = [(None if k % 50 == 3 else k % 90, t, "x") for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string").repartition(5)
    want = [(i, *brute(both, t)) for i, t, _ in rows]
    count = Counter(link for *_, links in want for link in links)
    highest = {}
    for (_, y), n in count.items():
        highest[y] = max(highest.get(y, 0), n)
    rows = []
    for i, n_a, n_b, form, links in want:
        best = sum(count[x] == highest[x[1]] for x in links)
        rows.append((i, n_a, n_b, len(links), form, len(links), best, sum(count[x] for x in links)))
    got = alignment.link_strengths(docs, alignment.vocabulary_paths())
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups", "n_links", "n_best", "count_sum"]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted(rows, key=key)
    hashed = alignment.align(docs, alignment.vocabulary_paths(), form="sha256").collect()
    assert {r.groups for r in hashed} == {hashlib.sha256(f.encode()).hexdigest() if f else "" for *_, f, _ in want}


def test_empty_table_and_bad_form(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.link_strengths(none, alignment.vocabulary_paths()).collect() == []
    with pytest.raises(ValueError):
        alignment.align(none, alignment.vocabulary_paths(), form="other")
