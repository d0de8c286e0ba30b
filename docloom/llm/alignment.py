"""Alignment of two tokenizers' tokens by whitespace-token anchors.

Each text, with a blank before it, is tokenized whole by a byte-level BPE (A) and by a sentencepiece
BPE (B). Both token lists spell the same bytes, so the places where a token of A and one of B end
together are comparable. Those of them that stand before a token with a space mark in both lists are
anchors: they split a document into windows, mostly a word each, and no group of tokens crosses one.
What a window's tokens come to (groups, linked pairs, their text form) depends on its token ids alone,
so it is worked out once for each pair of id tuples that a worker meets and remembered.

A linked pair's token ends are equal, so one token's bytes are the end of the other's. All such pairs of
two vocabularies can be listed beforehand (:func:`pair_universe`): at most one for each byte of each
token, some 400,000 for the public vocabularies, whatever the corpus. Counts over the corpus are an array
of that size, which bounds what is gathered and sent back to the tasks; no document and no link leaves
its partition. What a task found for its documents is written once and read again for the second look,
so texts are tokenized once.

Null and empty texts, and texts whose tokens do not spell them, have no tokens: all numbers 0, the form
empty. Null and repeated ids are treated row by row; a repeated text counts again. Other columns are not
read. An empty table gives no rows. A text is one row and held whole; several hundred MB of one text need
a worker with as many times a few GB.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.tables import stored

#: Windows that a worker remembers.
KNOWN_WINDOWS = 400_000
DOCS_AT_ONCE = 64
#: Longer runs of one kind of character go to the slower tokenizer, which has no limit for them.
LONG_RUN = re.compile(r"\s{2000}|[^\s]{20000}")


def vocabulary_paths() -> tuple[str, str, str]:
    """Places of the public vocabularies on the machine that asks: A, A as ranks, B."""
    import public_tokenizers

    return tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")))


class ByteTokens:
    """Tokenizer A. ``ranks`` names the same vocabulary in the form of a faster library, if there is one."""

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        of_letter = {c: b for b, c in _byte_letters().items()}
        vocabulary = self.slow.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, at in vocabulary.items():
            if all(c in of_letter for c in token):
                self.bytes[at] = bytes(of_letter[c] for c in token)
        self.fast = None
        if ranks is not None:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is not None and not (len(text) > 2000 and LONG_RUN.search(text)):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """Tokenizer B, which puts the blank before a text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for at in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(at)
            if self.model.is_control(at) or self.model.is_unknown(at):
                self.bytes.append(b"")
            elif self.model.is_byte(at):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.bytes.append(piece.replace("▁", " ").encode())

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself,
    all others by letters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


def pair_universe(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """All (A id, B id) that can end together, as sorted ``a * len(b) + b``: one spells the other's end."""
    ids: list[dict[bytes, list[int]]] = [{}, {}]
    for of, words in zip(ids, (a, b), strict=True):
        for at, word in enumerate(words):
            if word:
                of.setdefault(word, []).append(at)
    found: set[int] = set()
    for words, others, left in ((a, ids[1], True), (b, ids[0], False)):
        for at, word in enumerate(words):
            for begin in range(len(word)):
                for other in others.get(word[begin:], ()):
                    found.add(at * len(b) + other if left else other * len(b) + at)
    return np.array(sorted(found), "i8")


#: Parts ids of A and B in a window's key; larger than any id.
NO_ID = (1 << 16) - 1


def _ranges(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    sizes = ends - begins
    return np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)


def _shared(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of two rising lists of offsets stand in the other, too."""
    at = np.zeros(int(max(ends_a[-1:].max(initial=0), ends_b[-1:].max(initial=0))) + 1, "u1")
    at[ends_a] = 1
    at[ends_b] += 2
    return at[ends_a] == 3, at[ends_b] == 3


class Aligner:
    """Both tokenizers, the universe of pairs, and the windows a worker remembers."""

    def __init__(self, a_path: str, a_ranks: str | None, b_path: str):
        self.a, self.b = ByteTokens(a_path, a_ranks), PieceTokens(b_path)
        self.size = len(self.b.bytes)
        if max(len(self.a.bytes), self.size) > NO_ID or len(self.a.bytes) * self.size >= 1 << 32:
            raise ValueError("vocabularies are too large for ids of 16 and pairs of 32 bits")
        self.lengths = [np.array(list(map(len, t.bytes)), "i8") for t in (self.a, self.b)]
        self.marked = [np.array([w.startswith(b" ") for w in t.bytes]) for t in (self.a, self.b)]
        self.universe = pair_universe(self.a.bytes, self.b.bytes)
        #: ids as they are written: of A within a group, of A at its end, of B within, of B at its end
        self.written = [b"%d%c" % (i, mark) for mark, n in zip(b",|,;", self._sizes(), strict=True) for i in range(n)]
        #: Places of the windows remembered; their linked pairs, one for each group, as unsigned 32-bit
        #: ``a * size of B + b``; and their forms, with a semicolon behind each group.
        self.known: dict[bytes, int] = {}
        self.codes: list[bytes] = []
        self.forms: list[bytes] = []

    def _sizes(self) -> tuple[int, int, int, int]:
        return len(self.a.bytes), len(self.a.bytes), self.size, self.size

    def tokens(self, text: str | None) -> tuple[list[int], list[int]] | None:
        """Ids of a whole text in A and B; None if there are none or they do not spell it."""
        if not text:
            return None
        spelled = f" {text}"
        a, b, data = self.a.encode(spelled), self.b.encode(text), spelled.encode()
        for tokens, ids in ((self.a, a), (self.b, b)):
            if b"".join(map(tokens.bytes.__getitem__, ids)) != data:
                return None
        return a, b

    def align(self, texts: list[str | None]) -> list[tuple[int, int, bytes, bytes] | None]:
        """Numbers of tokens, linked pairs and form of each text; None as :meth:`tokens`."""
        found = [self.tokens(t) for t in texts]
        whole = [f for f in found if f is not None]
        a, b = (np.fromiter(itertools.chain.from_iterable([f[k] for f in whole]), "u2") for k in (0, 1))
        last_a, last_b = (np.cumsum([len(f[k]) for f in whole], dtype="i8") for k in (0, 1))
        to_a, to_b = self._anchors(a, b, last_a, last_b)
        places = self._look_up(a, b, to_a, to_b)
        begin, ends, out = 0, iter(np.searchsorted(to_a, last_a, "right").tolist()), []
        for f in found:
            if f is not None:
                end = next(ends)
                own = places[begin:end]
                codes = b"".join(map(self.codes.__getitem__, own))
                f = len(f[0]), len(f[1]), codes, b"".join(map(self.forms.__getitem__, own))[:-1]
                begin = end
            out.append(f)
        return out

    def _anchors(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows end, in tokens of A and B: shared ends before marked tokens, and ends of texts."""
        if not len(last_a):
            return last_a, last_b
        ends_a, ends_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        cut_a, cut_b = (np.append(self.marked[k][ids[1:]], True) for k, ids in ((0, a), (1, b)))
        cut_a[last_a - 1] = cut_b[last_b - 1] = True
        to_a, to_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
        in_a, in_b = _shared(ends_a[to_a], ends_b[to_b])
        return to_a[in_a] + 1, to_b[in_b] + 1

    def _look_up(self, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> list[int]:
        """The windows that end there, as places in ``codes`` and ``forms``; those not remembered are aligned,
        each once. A window is known by its ids of A, a number that is no id, and its ids of B."""
        n = np.arange(len(to_a))
        both = np.full(len(a) + len(b) + len(n), NO_ID, "u2")
        both[np.arange(len(a)) + np.repeat(np.append(0, to_b[:-1]) + n, np.diff(to_a, prepend=0))] = a
        both[np.arange(len(b)) + np.repeat(to_a + n + 1, np.diff(to_b, prepend=0))] = b
        data, ends = both.tobytes(), (2 * (to_a + to_b + n + 1)).tolist()
        keys = [data[i:j] for i, j in zip([0, *ends], ends, strict=False)]
        if len(self.known) > KNOWN_WINDOWS:
            self.known, self.codes, self.forms = {}, [], []
        places = list(map(self.known.get, keys))
        if None in places:
            new = {key: at for at, key in enumerate(keys) if places[at] is None}
            at = np.array(list(new.values()))
            begin_a, begin_b = (np.append(0, x[:-1])[at] for x in (to_a, to_b))
            self._groups(a, b, begin_a, to_a[at], begin_b, to_b[at])
            self.known.update(zip(new, range(len(self.known), len(self.forms)), strict=True))
            places = list(map(self.known.__getitem__, keys))
        return places

    def _groups(self, a, b, begin_a, end_a, begin_b, end_b) -> None:
        """Align windows, given by where they begin and end in tokens of A and of B."""
        a, b = a[_ranges(begin_a, end_a)].astype("i8"), b[_ranges(begin_b, end_b)].astype("i8")
        closes_a, closes_b = _shared(np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b]))
        last_a, last_b = np.flatnonzero(closes_a), np.flatnonzero(closes_b)
        codes = (a[last_a] * self.size + b[last_b]).astype("<u4").tobytes()
        group_a = np.cumsum(closes_a) - closes_a  # the group of each token
        group_b = np.cumsum(closes_b) - closes_b
        # groups stand in turn, in each the ids of A before those of B
        order = np.empty(len(a) + len(b), "i8")
        n_a, _, n_b, _ = self._sizes()
        order[np.arange(len(a)) + np.append(0, last_b + 1)[group_a]] = a + n_a * closes_a
        order[np.arange(len(b)) + (last_a + 1)[group_b]] = b + 2 * n_a + n_b * closes_b
        written = list(map(self.written.__getitem__, order.tolist()))
        tokens = np.cumsum(end_a - begin_a + end_b - begin_b).tolist()
        groups = (4 * np.searchsorted(last_a, np.cumsum(end_a - begin_a))).tolist()
        self.forms += [b"".join(written[i:j]) for i, j in zip([0, *tokens], tokens, strict=False)]
        self.codes += [codes[i:j] for i, j in zip([0, *groups], groups, strict=False)]


@functools.lru_cache(maxsize=1)
def aligner(*paths: str | None) -> Aligner:
    """One for all tasks of a worker process."""
    return Aligner(*paths)


ALIGNED = T.StructType(
    [
        T.StructField("n_a", T.LongType()),
        T.StructField("n_b", T.LongType()),
        T.StructField("n_groups", T.LongType()),
        T.StructField("groups", T.StringType()),
        T.StructField("pairs", T.BinaryType()),
        T.StructField("times", T.BinaryType()),
    ]
)


def align(
    docs: DataFrame,
    paths: tuple[str, str | None, str],
    id_column: str = "doc_id",
    text_column: str = "text",
    form: str = "groups",
) -> DataFrame:
    """One row for each document: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``groups`` (the whole alignment as
    ``a1,a2|b1;a3|b2,b3``, or its SHA-256 in hex with ``form="sha256"``), and the linked pairs as ``pairs``
    (unsigned 32-bit places in the universe, each once) with their ``times``.

    ``paths`` are A, A as ranks of the faster library or None, and B, on every machine.
    """
    if form not in ("groups", "sha256"):
        raise ValueError(f"no form {form}")
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    schema = T.StructType([narrow.schema["doc_id"], *ALIGNED.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        both = aligner(*paths)
        for batch in batches:
            for k in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(k, DOCS_AT_ONCE)
                columns: list[list] = [[] for _ in ALIGNED.fields]
                for got in both.align(part.column(1).to_pylist()):
                    row = (0, 0, 0, "", b"", b"")
                    if got is not None:
                        n_a, n_b, codes, whole = got
                        whole = hashlib.sha256(whole).hexdigest() if form == "sha256" else whole.decode()
                        codes = np.frombuffer(codes, "<u4")
                        some, times = np.unique(codes, return_counts=True)
                        pairs = np.searchsorted(both.universe, some.astype("i8"))
                        row = (n_a, n_b, len(codes), whole, pairs.astype("<u4").tobytes(), times.astype("<u4").tobytes())
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, t) for c, t in zip(columns, _ARROW, strict=True))], schema.names
                )

    return narrow.mapInArrow(run, schema)


_ARROW = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())


def pair_counts(aligned: DataFrame, size: int) -> np.ndarray:
    """How many links of the corpus hold each pair of a universe of ``size``.

    Each task sums into one array of that size and gives the pairs it saw, so at most ``size`` rows a task are
    shuffled and ``size`` rows come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, "i8")
        for batch in batches:
            for pairs, times in zip(batch.column(0), batch.column(1), strict=True):
                sums[np.frombuffer(pairs.as_py(), "<u4")] += np.frombuffer(times.as_py(), "<u4")
        seen = np.flatnonzero(sums)
        for k in range(0, len(seen), 50_000):
            some = seen[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[some], pa.int64())], ["pair", "n"])

    counts = aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    out = np.zeros(size, "i8")
    out[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    return out


def link_strengths(
    docs: DataFrame,
    paths: tuple[str, str | None, str],
    id_column: str = "doc_id",
    text_column: str = "text",
    form: str = "groups",
) -> DataFrame:
    """:func:`align` of all documents with ``n_links``, ``n_best`` (links whose pair is the corpus's most frequent
    for its B id, ties included) and ``count_sum`` (the pairs' corpus counts, over all links)."""
    both = aligner(*paths)
    universe, size_b = both.universe, len(both.b.bytes)
    aligned = stored(align(docs, paths, id_column, text_column, form), "aligned")
    counts = pair_counts(aligned, len(universe))
    highest = np.zeros(size_b, "i8")
    np.maximum.at(highest, universe % size_b, counts)
    shared = docs.sparkSession.sparkContext.broadcast((counts, counts == highest[universe % size_b]))
    schema = T.StructType([*aligned.schema.fields, *(T.StructField(n, T.LongType()) for n in ("n_links", "n_best", "count_sum"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, best = shared.value
        for batch in batches:
            found = []
            for pairs, times in zip(batch.column("pairs"), batch.column("times"), strict=True):
                at, n = np.frombuffer(pairs.as_py(), "<u4"), np.frombuffer(times.as_py(), "<u4").astype("i8")
                found.append((int(n.sum()), int(n[best[at]].sum()), int(np.dot(n, of[at]))))
            more = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema.names)

    return aligned.mapInArrow(run, schema)
