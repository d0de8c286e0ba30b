"""Each stage on its own input, and the whole."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from docloom.llm import decontamination, language, packing, toxicity
from docloom.llm.tables import learnable, read, stored
from tests.llm.test_jaccard import brute

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are missing")


def test_stages(spark):
    stages = dict(pipeline.STAGES)
    docs = read(spark, SF_DIR, "documents")
    clean = stored(stages["toxicity"](spark, docs, SF_DIR), "test")
    model = toxicity.fit(docs, read(spark, SF_DIR, "labels"), learnable("doc_id"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, t in texts.items() if model.score(t) < toxicity.THRESHOLD}

    named = stored(stages["language_id"](spark, clean, SF_DIR), "test")
    model = language.fit(clean, learnable("doc_id"))
    sure = {r.doc_id for r in clean.collect() if language.judge_text(model, r.text)[1] >= pipeline.MIN_LANGUAGE_SCORE}
    assert {r.doc_id for r in named.collect()} == sure and len(sure) > 0.95 * clean.count()

    single = stored(stages["ngram_jaccard_join"](spark, named, SF_DIR), "test")
    groups = brute([(r.doc_id, r.text) for r in named.collect()])
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, _, c in groups})

    kept = stored(stages["benchmark_decontamination"](spark, single, SF_DIR), "test")
    items = [(str(r.item_id), r.text) for r in read(spark, SF_DIR, "benchmark").collect()]
    automaton = decontamination.Automaton.of(items)
    before = {r.doc_id: r.text for r in single.collect()}
    rows = kept.collect()
    assert all(not automaton.scan(decontamination.words_of(r.text))[0] and r.n_chars == len(r.text) for r in rows)
    hit = {i for i, t in before.items() if automaton.scan(decontamination.words_of(t))[0]}
    assert {r.doc_id for r in rows if r.text != before[r.doc_id]} | (before.keys() - {r.doc_id for r in rows}) == hit

    pieces = stages["packing"](spark, kept, SF_DIR).collect()
    totals = {}
    for p in pieces:
        totals[p.doc_id] = totals.get(p.doc_id, 0) + p.length
    assert totals == {p.doc_id: p.doc_tokens for p in pieces} and set(totals) == {r.doc_id for r in rows}
    for stage in (clean, named, single, kept):
        assert stage.columns == docs.columns


def test_run_and_edge_rows(spark):
    done = entry.queries()["pipeline"](spark, SF_DIR)
    assert done.count() > 0 and "ids" in done.columns
    odd = spark.createDataFrame(
        [(1, None, None, None, None), (None, "the of and in", "en", "s", 13), (2, "", "en", None, 0), (2, "", "en", None, 0)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for rows in (odd, odd.limit(0)):
        docs = rows
        for name, stage in pipeline.STAGES:
            docs = stored(stage(spark, docs, SF_DIR), f"odd-{name}")
            assert name == "packing" or docs.columns == odd.columns
    assert packing.tokenizer_path()
