"""Packing by power-of-two decomposition.

Each document becomes token ids plus an end id, and is cut into pieces whose lengths are powers of
two: as many of ``max_length`` as fit, then the binary digits of the rest, long ones first. A piece
is a sequence of its own, so no sequence crosses documents and none needs padding; a training step
draws its batch from one bucket of equal lengths. The work is narrow: no row moves, whatever the
share of one source or the length of one document.

Null text counts as empty, a document of the end id alone. Null and repeated ids are kept: each row
is packed by itself. Other columns of the input are not read. An empty table gives no pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.workers import begin, kept

MAX_LENGTH = 2048
END_ID = 1
#: A longer text is tokenized in parts, cut at white space, where tokens never cross.
PART_CHARS = 1 << 20
#: Words whose ids a worker remembers.
CACHE_WORDS = 200_000
DOCS_AT_ONCE = 256
#: Stands between words that are tokenized in one call. On its own it is one token.
MARK = "\x1e"

_CUT = re.compile("[ \n]")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """``text`` in parts of about ``size``, each but the first beginning with a blank or line feed."""
    begin = 0
    while len(text) - begin > size:
        cut = _CUT.search(text, begin + size)
        if cut is None:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


class WordTokens:
    """Token ids of texts, word by word: a word seen before is looked up.

    Words are what stands between blanks and line feeds. Ids of a text are the ids of its words in
    turn, since this kind of tokenizer drops white space and no token spans it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [c for c in map(chr, range(128, 256)) if c.isalpha()]
        self.letters = str.maketrans({c: as_bytes.pre_tokenize_str(c)[0][0] for c in letters})
        (self.mark_id,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.known: dict[str, bytes] = {"": b""}

    def words(self, text: str) -> list[str]:
        if "<|" not in text:
            try:  # Latin-1 lower case is the tokenizer's own; it makes more words equal
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").split(" ")

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known = {"": b""}
        known = self.known
        rest, tailed = [], []
        for w in words:
            if w in known:
                continue
            stem = w[:-1] if w[-1] in ",." else w
            plain = self.plain(stem)
            if plain is None:
                rest.append(w)
                continue
            if stem not in known:
                known[stem] = np.array([t.id for t in self.tokenizer.model.tokenize(plain)], "<u4").tobytes()
            if stem != w:  # a mark after such a word is a token of its own
                tailed.append(w)
        self.learn_others(rest)
        if tailed:
            self.learn_others([m for m in ",." if m not in known])
            for w in tailed:
                known[w] = known[w[:-1]] + known[w[-1]]

    def plain(self, word: str) -> str | None:
        """A word of lower-case Latin-1 letters as the tokenizer's model reads it; else None.

        Normalizing and splitting leave such a word as it is, so the model can be asked directly.
        """
        if not (word.isalpha() and word.islower()):
            return None
        if word.isascii():
            return word
        try:
            word.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return word.translate(self.letters)

    def learn_others(self, words: list[str]) -> None:
        for w in [w for w in words if MARK in w]:
            ids = self.tokenizer.encode_batch_fast([w], add_special_tokens=False)[0].ids
            self.known[w] = np.array(ids, "<u4").tobytes()
        new = [w for w in words if MARK not in w]
        for k in range(0, len(new), 1000):
            some = new[k : k + 1000]
            joined = f" {MARK} ".join(some)
            got = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids
            ids = np.array(got, "<u4")
            ends = np.flatnonzero(ids == self.mark_id).tolist() + [len(ids)]
            data, begin = ids.tobytes(), 0
            for w, end in zip(some, ends, strict=True):
                self.known[w] = data[4 * begin : 4 * end]
                begin = end + 1

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        if sum(map(len, texts)) > PART_CHARS:
            for text in texts:
                done = []
                for part in text_parts(text):
                    words = self.words(part)
                    self.learn(set(words))
                    done.append(b"".join([self.known[w] for w in words]))
                yield b"".join(done)
            return
        split = [self.words(t) for t in texts]
        self.learn(set().union(*split))
        known = self.known
        for words in split:
            yield b"".join([known[w] for w in words])


@kept
def word_tokens(path: str) -> WordTokens:
    """One for all tasks of a worker process."""
    return WordTokens(path)


def binary_lengths(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of ``n`` tokens, in order."""
    full, rest = divmod(n, max_length)
    return [max_length] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def decompose(
    docs: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    max_length: int = MAX_LENGTH,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of all documents: the id, ``start`` (its document's ids before it), ``length``,
    ``bucket`` (log2 of the length), ``ids`` (little-endian unsigned 32-bit numbers, as
    ``numpy.frombuffer(ids, "<u4")`` reads them) and ``doc_tokens``.

    ``tokenizer`` is the path of a tokenizers file on every machine.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    end = np.array([end_id], "<u4").tobytes()
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text"))
    schema = T.StructType(
        [
            narrow.schema["doc_id"],
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("bucket", T.IntegerType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
        ]
    )
    names = schema.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        begin("packing")
        tokens = word_tokens(tokenizer)
        for batch in batches:
            for k in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(k, DOCS_AT_ONCE)
                rows, starts, lengths, ids, totals = [], [], [], [], []
                for row, data in enumerate(tokens.encode(part.column(1).to_pylist())):
                    data += end
                    at, total = 0, len(data) // 4
                    for length in binary_lengths(total, max_length):
                        rows.append(row)
                        starts.append(at)
                        lengths.append(length)
                        ids.append(data[4 * at : 4 * (at + length)])
                        totals.append(total)
                        at += length
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows, pa.int64())),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([x.bit_length() - 1 for x in lengths], pa.int32()),
                        pa.array(ids, pa.binary()),
                        pa.array(totals, pa.int64()),
                    ],
                    names,
                )

    return narrow.mapInArrow(cut, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``: each piece is a sequence, and begins at 0.

    The number is made from the place in the input files, so a task that runs again gives the same.
    """
    return pieces.withColumns(
        {"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")}
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per length. Each task writes its own files, so a bucket that holds most pieces
    is written by all tasks."""
    pieces.write.partitionBy("bucket").parquet(path)
