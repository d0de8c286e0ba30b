import os
import re

import numpy as np
import pytest

from docloom.llm import language as L
from docloom.llm.queries import QUERIES
from docloom.llm.tables import learnable

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are missing")
def test_held_out_accuracy(spark):
    got = QUERIES["op3_language_id"](spark, SF_DIR).toPandas()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(both) == len(docs) and got.score.between(0, 1).all()
    held = both[both.held_out]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.97


def slow_grams(text):
    kept = " ".join(re.findall(r"[^\W\d_]+", text.lower()))
    kept = f" {kept} " if kept else ""
    return {kept[i : i + n] for n in L.SIZES for i in range(len(kept) - n + 1)}


def test_masks_hold_every_kept_gram_of_every_language(spark):
    texts = {"de": "der hund läuft", "en": "the dog runs", "fr": "le chien court"}
    rows = [(i, t, k) for i, (k, t) in enumerate(texts.items())] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs, learnable("doc_id") | ~learnable("doc_id"))
    assert model.languages == ("de", "en", "fr")
    for bit, text in enumerate(texts.values()):
        masks = model.lookup(L.gram_hashes(L.letters_only(text)))
        assert len(masks) >= len(slow_grams(text)) and ((masks >> bit & 1) == 1).all()
        assert L.judge_text(model, text)[0] == model.languages[bit]


def test_edge_rows(spark):
    rows = [(1, "der hund", "de", 1), (2, "the dog", "en", 1), (3, None, None, 1), (4, "", "", 1), (None, "12 34", "en", 1), (6, "日本", None, 1), (1, "der hund", "de", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int").drop("lang_pred")
    model = L.fit(docs, learnable("doc_id") | ~learnable("doc_id"))
    got = [(r.doc_id, r.lang_pred, r.score) for r in L.identify(docs, model).collect()]
    assert [g[1] for g in got if g[0] == 1] == ["de", "de"]
    assert {g[1:] for g in got if g[0] in (3, 4, None)} == {("und", 0.0)}
    assert [g[1:] for g in got if g[0] == 6] == [(model.fallback, 0.0)]
    nothing = L.fit(docs.limit(0), learnable("doc_id"))
    assert {r.lang_pred for r in L.identify(docs, nothing).collect()} == {"und"}
    assert L.identify(docs.limit(0), model).count() == 0


def test_long_texts_are_read_whole(monkeypatch):
    text = "abc déf ghi " * 300
    whole = np.sort(np.concatenate(list(L.text_hashes(text))))
    monkeypatch.setattr(L, "PART_CHARS", 100)
    parts = np.concatenate(list(L.text_hashes(text)))
    assert set(parts.tolist()) == set(whole.tolist()) and abs(len(parts) - len(whole)) < len(text) // 100 * 4
