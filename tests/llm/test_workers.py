import pyarrow as pa

from docloom.llm import packing, workers


def test_a_worker_keeps_for_one_operator_only():
    """The tokenizer stays for the next task of packing, and goes when another operator's begins."""
    workers.begin("packing")
    packing.word_tokens.cache_clear()
    path = packing.tokenizer_path()
    tokens = packing.word_tokens(path)
    workers.begin("packing")
    assert packing.word_tokens(path) is tokens
    workers.begin("toxicity")
    assert packing.word_tokens.cache_info().currsize == 0
    assert packing.word_tokens(path) is not tokens


def test_tokenizers_go_from_spark_workers(spark):
    """Tasks of toxicity find no tokenizer that packing left in their process."""
    from docloom.llm import toxicity as X

    docs = spark.createDataFrame([(i, f"word number {i}") for i in range(40)], "doc_id long, text string").repartition(8)
    packing.decompose(docs, packing.tokenizer_path()).count()
    model = X.Model(X.Lexicon({}), X.np.zeros(len(X.FEATURES)), -40.0)

    def left(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([packing.word_tokens.cache_info().currsize])], ["n"])

    assert sum(r.n for r in docs.select("doc_id").mapInArrow(left, "n long").collect()) > 0
    for _ in range(4):  # idle workers take turns
        assert X.score(docs.repartition(16), model).filter("score > 0.5").count() == 0
    assert sum(r.n for r in docs.select("doc_id").mapInArrow(left, "n long").collect()) == 0


def test_counting_of_n_grams_and_the_join_say_whose_task_it_is():
    """What packing keeps goes when language counts n-grams, or the join reads stored sets."""
    from docloom.llm import jaccard, language

    path = packing.tokenizer_path()
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array(["some words"])], ["lang", "text"])
    workers.begin("packing")
    packing.word_tokens(path)
    assert list(language._count(iter([batch])))
    assert packing.word_tokens.cache_info().currsize == 0
    workers.begin("packing")
    packing.word_tokens(path)
    assert list(jaccard._join_cells(80)(iter([]))) == []
    assert packing.word_tokens.cache_info().currsize == 0


def test_scores_beside_all_columns_wait_nowhere(spark):
    """Scores and languages come through slices, with all other columns, and replace columns of their name."""
    from docloom.llm import language as L
    from docloom.llm import toxicity as X

    rows = [(i, None if i % 7 == 0 else f"text {i}", [i], "old") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more array<long>, score string").coalesce(1)
    toxic = X.score(docs, X.Model(X.Lexicon({}), X.np.zeros(len(X.FEATURES)), -40.0))
    model = L.Model(L.np.zeros(L.PLACES, "u1"), ("en",), L.np.zeros(1), "en")
    found = L.predict(docs, model, "text", "lang", "score")
    assert toxic.columns == ["doc_id", "text", "more", "score"]
    assert found.columns == ["doc_id", "text", "more", "lang", "score"]
    for df in (toxic, found):
        assert "ArrowEvalPython" not in df._jdf.queryExecution().toString()
        got = sorted(df.collect())
        assert [(r.doc_id, r.text, r.more) for r in got] == [r[:3] for r in rows]
        assert {type(r.score) for r in got} == {float}
    assert {(r.text is None, r.lang) for r in found.collect()} == {(True, L.UNKNOWN), (False, "en")}
