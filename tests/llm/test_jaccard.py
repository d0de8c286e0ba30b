import random
import re

import numpy as np
import pytest

from docloom.llm import jaccard as J
from docloom.llm import shingles
from docloom.llm.components import components


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingle_set(text):
    words = words_of(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc_id)
    return sorted((d, len(sets[i]), min(ids[find(i)]) if sets[i] else d) for i, (d, _) in enumerate(rows))


def texts(seed, n):
    """Near copies of a few texts at many distances, passages that texts share, copies, short texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz") + str(rng.randint(0, 30))
    bases = [[word() for _ in range(rng.randint(20, 150))] for _ in range(6)]
    passage = [word() for _ in range(40)]
    made = []
    for _ in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = word()
        made.append(" ".join(words))
    made += [" ".join([word() for _ in range(12)] + passage) for _ in range(n // 4)]
    made += ["A b c", "a B\tc", "a b", "", None, " \n", "x", "X", *made[:5]]
    return list(enumerate(made))


@pytest.mark.parametrize("block", [J.BLOCK, 8])
def test_components_against_brute_force(spark, block, monkeypatch):
    rows = texts(block, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as cid", "3 as root")
    got = J.with_component(J.join(docs.repartition(3), block=block)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    kept = J.one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute(rows)})


def test_null_ids_repeats_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "z"), (None, "z"), (7, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in J.with_component(J.join(docs)).collect())
    assert got == [(0, 1, 0), (0, 1, 0), (0, 2, 5), (5, 2, 5), (5, 2, 5), (7, 0, 7), (7, 0, 7)]
    assert sorted((r.doc_id or 0, r.text or "") for r in J.one_per_component(docs).collect()) == [(0, "z"), (5, "a b c d e f"), (7, "")]
    assert J.with_component(J.join(docs.limit(0))).count() == 0 and J.one_per_component(docs.limit(0)).count() == 0


def test_tree_loses_no_link():
    rng = np.random.default_rng(3)
    for _ in range(8):
        n = int(rng.integers(2, 160))
        base = [np.unique(rng.integers(0, 1 << 48, int(rng.integers(5, 120)), dtype="u8")) for _ in range(4)]
        sets = []
        for _ in range(n):
            whole = base[rng.integers(0, 4)]
            kept = whole[rng.random(len(whole)) > rng.random() * 0.25]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 1 << 48, int(rng.integers(0, 10)), dtype="u8")])))
        sizes, points = np.array([len(x) for x in sets]), np.stack([J.counts_of(x) for x in sets]).astype("i4")
        comps, sides = rng.integers(0, max(2, n // 3), n), rng.integers(0, 2, n)
        as_sets = [set(x.tolist()) for x in sets]
        for across in (False, True):
            i, j = J.tree_pairs(points, sizes, comps, sides, across, 80)
            got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
            assert len(got) == len(i)
            for a in range(n):
                for b in range(a):
                    fits = comps[a] != comps[b] and (not across or sides[a] != sides[b])
                    if fits and 100 * len(as_sets[a] & as_sets[b]) >= 80 * len(as_sets[a] | as_sets[b]):
                        assert (b, a) in got
                    assert fits or (b, a) not in got


def test_shingles_and_packing_of_tokens():
    text = "One two  three\tfour\nfive six ONE two three four five é 😀 x"
    assert len(shingles.shingle_set(text)) == len(shingle_set(text))
    assert shingles.shingle_set("A b").tolist() == shingles.shingle_set("a\nB").tolist()
    assert len(shingles.shingle_set(None)) == len(shingles.shingle_set(" \n")) == 0
    tokens = np.unique(shingles.shingle_set(text) & J.TOKEN_BITS)
    assert (J.unpack(J.pack(tokens)) == tokens).all()
    long = " ".join(map(str, range(40_000)))
    assert len(shingles.shingle_set(long)) == 39_996


def test_large_counts_bound_nothing():
    tokens = np.zeros(300, "u8") + np.arange(300, dtype="u8")  # one group for all
    assert J.counts_of(tokens)[0] == 255
    assert J.as_points(J.pa.array([J.counts_of(tokens).tobytes()]))[0, 0] > 300


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 3), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
