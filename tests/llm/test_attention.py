import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import attention
from docloom.llm.attention_query import held_out, op13_quality_classifier
from docloom.llm.tables import read

SF_DIR = "/root/testdata/sf0.1"


def plain_score(model, text):
    """The score by loops over passages, all at once."""
    w = {k: v.astype(float) for k, v in model.weights.items()}
    passages = [row.astype(float) for part in attention.passage_counts(text) for row in part]
    encoded, weights = [], []
    for row in passages:
        n = attention.KINDS**2
        pairs, words = row[:n], row[n:]
        x = np.sqrt(np.concatenate([pairs / max(1, pairs.sum()), words / max(1, words[: attention.BUCKETS].sum())]))
        h = [max(0.0, float(x @ w["encode"][:, j] + w["shift"][j])) for j in range(attention.HIDDEN)]
        gated = [
            math.tanh(float(np.dot(h, w["look"][:, g]))) / (1 + math.exp(-float(np.dot(h, w["gate"][:, g]))))
            for g in range(attention.GATES)
        ]
        encoded.append(h)
        weights.append(math.exp(float(np.dot(gated, w["attend"]))))
    z = np.zeros(attention.HIDDEN)
    for h, a in zip(encoded, weights, strict=True):
        z += np.array(h) * a / sum(weights)
    return 1 / (1 + math.exp(-float(z @ w["judge"] + w["bias"][0])))


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(3)
    return attention.Model({k: rng.normal(size=s).astype("f4") for k, s in attention.SHAPES.items()})


def test_scores_are_those_of_loops(model, monkeypatch):
    texts = ["one two three. " * 40, "A\u00c9 9|#\x00\t\n" * 70, "word", "x" * 5000, "", None, " \n\t", "the same " * 500]
    for size in (1 << 20, 300):
        monkeypatch.setattr(attention, "PART_BYTES", size)
        for text in texts:
            assert model.score(text) == pytest.approx(plain_score(model, text), abs=1e-5)


def test_passages_hold_every_word_once(monkeypatch):
    text = "some words here " * 100
    for size in (1 << 20, 200):
        monkeypatch.setattr(attention, "PART_BYTES", size)
        counts = np.concatenate(list(attention.passage_counts(text)))
        n = attention.KINDS**2
        assert counts[:, n : n + attention.BUCKETS].sum() == 300
        assert size == 200 or [int(c[n : n + attention.BUCKETS].sum()) for c in counts] == [40] * 7 + [20]


def test_gradients_are_those_of_differences():
    rng = np.random.default_rng(5)
    w = {k: rng.normal(size=s) * 0.3 for k, s in attention.SHAPES.items()}
    x, bags, y = rng.random((9, attention.COUNTS)) * 0.1, np.array([0, 0, 0, 1, 3, 3, 3, 3, 3]), np.array([1.0, 0, 1, 0])
    _, grads = attention.gradients(w, x, bags, y)
    for name in attention.SHAPES:
        for _ in range(4):
            at = tuple(int(rng.integers(n)) for n in w[name].shape)
            losses = []
            for step in (1e-5, -1e-5):
                w[name][at] += step
                losses.append(attention.gradients(w, x, bags, y)[0])
                w[name][at] -= step
            assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(float(grads[name][at]), rel=1e-2, abs=1e-6)


def test_attention_finds_the_passage_that_earns_the_label():
    rng = np.random.default_rng(0)
    plain = "of the and to in that it was for on are as with his they at be this have from".split()
    bags, y, bad = [], [], "<<== ##!! ==>> " * 14
    for k in range(300):
        parts = [" ".join(rng.choice(plain, 40)) for _ in range(rng.integers(2, 8))]
        if k % 2:
            parts[rng.integers(len(parts))] = bad.strip()[:-1]
        bags.append(np.concatenate(list(attention.passage_counts(" ".join(parts)))))
        y.append(1 - k % 2)
    weights = attention.learn(bags[:200], np.array(y[:200], float))
    model = attention.Model(weights)
    for bag, label in zip(bags[200:], y[200:], strict=True):
        h, e = model.attention(bag)
        a = np.exp(e) / np.exp(e).sum()
        assert (float(a @ h @ weights["judge"] + weights["bias"][0]) > 0) == bool(label)
        signs = bag[:, 10 * attention.KINDS : 11 * attention.KINDS].sum(1)
        if not label:
            assert a[signs.argmax()] > 1.2 / len(a)


def test_held_out_labels(spark):
    got = op13_quality_classifier(spark, SF_DIR).join(read(spark, SF_DIR, "labels"), "doc_id").filter("held_out")
    row = got.agg(
        F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("right"),
        F.avg(F.when(F.col("quality") == 0, 1 - F.col("predicted"))).alias("bad"),
    ).first()
    assert row.right > 0.97 and row.bad > 0.9


def test_edge_rows(spark):
    docs = spark.createDataFrame(
        [(1, "good words", 9.0), (1, "other words", 9.0), (2, None, 9.0), (None, "words", 9.0), (3, "", 9.0), (4, "###", 9.0)],
        "doc_id long, text string, score double",
    )
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (9, 1), (4, 0)], "doc_id long, quality int")
    bags = attention.labelled_bags(docs, labels, ~held_out("doc_id") | F.lit(True))
    assert sorted((r.doc_id, r.label, r.n) for r in bags.collect()) == [(1, 1, 1), (2, 0, 0), (4, 0, 1)]
    scored = attention.score(docs, attention.fit(docs, labels, F.lit(True)))
    assert scored.columns == docs.columns and scored.filter("score between 0 and 1").count() == 6
    for some, constant in ((labels.limit(0), 0.5), (labels.filter("quality = 1"), 1.0), (labels.filter("quality = 0 and doc_id > 1"), 0.0)):
        flat = attention.score(docs, attention.fit(docs, some, F.lit(True)))
        assert {r.score for r in flat.collect()} == {constant}
    assert attention.score(docs.limit(0), attention.fit(docs.limit(0), labels, F.lit(True))).count() == 0
    few = attention.fit(docs, labels, F.lit(True), train_passages=1)
    assert attention.score(docs, few).count() == 6
