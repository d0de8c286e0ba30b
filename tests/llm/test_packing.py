import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def test_words_give_the_ids_of_the_text(tokenizer, monkeypatch):
    letters = "aeéÉßẞÿµªº ΣσςİIı½²Ⅷ'’'s't.,,..!?|<>\x1e\x00\t\n\r\x0b\x85  ́e̊日本가😀<|endoftext|> <|STARTOFTEXT|> zé'll"
    rng = random.Random(5)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["<|endoftext|> a", "É. é, a., ab.", "x́. ́a", "İ.", "word, " * 9]
    want = [np.array(ids_of(tokenizer, t)[:-1], "<u4").tobytes() for t in texts]
    words = packing.WordTokens(packing.tokenizer_path())
    assert list(words.encode(texts)) == want
    monkeypatch.setattr(packing, "PART_CHARS", 10)
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    assert list(words.encode(texts)) == want


def test_binary_lengths():
    assert packing.binary_lengths(1) == [1]
    assert packing.binary_lengths(13, 8) == [8, 4, 1]
    assert packing.binary_lengths(24, 8) == [8, 8, 8]


def test_pieces_give_back_each_document(spark, tokenizer):
    long = "one two, three. " * 2000
    rows = [(1, "a b c", "x"), (2, None, None), (3, "", "x"), (None, "null id", "x"), (1, "a b c", "x"), (4, long, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.sequences(packing.decompose(docs, packing.tokenizer_path(), max_length=256)).collect()
    assert len({r.sequence_id for r in got}) == len(got) and {r.offset for r in got} == {0}
    assert all(r.length == 1 << r.bucket == len(r.ids) // 4 for r in got)
    for doc_id, text, times in ((1, "a b c", 2), (2, "", 1), (3, "", 1), (None, "null id", 1), (4, long, 1)):
        want = np.array(ids_of(tokenizer, text), "<u4").tobytes()
        mine = sorted((r.start, bytes(r.ids)) for r in got if r.doc_id == doc_id)
        assert b"".join(x for _, x in mine[::times]) == want
        assert {r.doc_tokens for r in got if r.doc_id == doc_id} == {len(want) // 4}


def test_empty_table_and_bad_length(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.decompose(none, packing.tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        packing.decompose(none, packing.tokenizer_path(), max_length=100)


def test_buckets_hold_equal_lengths(spark, tmp_path):
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), F.col("id").cast("int")).alias("text"))
    packing.write_buckets(packing.decompose(docs, packing.tokenizer_path()), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.filter("length != shiftleft(1, bucket)").count() == 0
    assert back.agg(F.sum("length")).first()[0] == sum(range(1, 21))
