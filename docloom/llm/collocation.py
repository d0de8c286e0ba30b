"""Phrase collocations by SETM: occurrence relations, joined with themselves place by place.

Texts are cut into pieces and words, and the words dealt into blocks of ``block_words``. A relation has a row for
each block: the sorted places at which a frequent phrase of its length begins, and which phrase it is. A place is
left out where a piece ends, so neighbours in a piece are places one apart, and nothing is joined across.

Each round merges the relation with itself: two frequent phrases one place apart are a phrase one word longer.
Each block's distinct ones are counted, and the counts of all blocks grouped by phrase; those seen ``min_count``
times are frequent. Then the merged relation is semi-joined with these and written for the next round. What is
shuffled are the distinct phrases of blocks, packed by hash of the phrase; occurrences stay in their blocks,
and a phrase, however common, is moved once a block.

The semi-join looks a block's phrases up in a broadcast of the frequent ones while these are at most
``broadcast_phrases``. Beyond, a block's distinct phrases are joined with the table of the frequent ones, and what is
found goes back to its block.

A long text runs over as many blocks as it takes. A block that ends inside a text borrows the words that phrases
begun before its end still need; phrases that begin with a borrowed word are the next block's to count.

Phrases of a language keep the counts of their beginnings and ends from round to round, so cuts are scored by
two joins a round, in decimals of 38 digits. If a phrase stands in a longer candidate of the same count, it
stands in one just a word longer of that count, too; so one look at the next length finds it.

Null text is empty, a null language counts as ``und`` together with that language itself. Ids are not read;
repeated rows count again. Other columns are not read. Of phrases with equal score and count the smaller in
UTF-8 byte order comes first. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.shingles import mix
from docloom.llm.tables import discard, stored

MAX_WORDS = 5
MIN_COUNT = 100
#: A phrase goes if a longer candidate has this share of its count, in hundredths.
KEEP_SHARE = 100
TOP = 2000
#: Places of a block: what a task holds at once, in words.
BLOCK_WORDS = 1 << 18
#: Bytes of a text that are split into words at once.
PART_BYTES = 1 << 20
#: Words a task counts before it passes the counts on, and words whose longer phrases go to one bucket.
COUNTED_WORDS, BUCKET_WORDS = 500_000, 2_000_000
#: Frequent phrases of one length that are broadcast, at most: ids and, of single words, their letters.
BROADCAST_PHRASES = 500_000
NO_LANGUAGE = "und"

#: Ends of pieces become line feeds, tabs blanks, A-Z lower case; all of them are single bytes.
_BYTES = bytes(
    10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c in (9, 32) else c + 32 if 65 <= c <= 90 else c for c in range(256)
)
_END = b"\n"

#: A block's relation: sorted places as ``gaps`` from each to the next and, at each, the phrase by number in the
#: block, of which ``ids`` are the phrases. Places from ``own`` on are borrowed. The lists are packed numbers of
#: 64 bits, so that a task unpacks one block at a time however many are read at once.
RELATION = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("gaps", T.BinaryType()),
        T.StructField("phrases", T.BinaryType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("own", T.IntegerType()),
    ]
)


def _packed(numbers: np.ndarray) -> bytes:
    return zstandard.compress(numbers.astype("<i8").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), "<i8")


def _relation_row(block: int, places: np.ndarray, ids: np.ndarray, own: int) -> pa.RecordBatch:
    """The relation of a block, from the id of the phrase at each place."""
    own_ids, numbers = np.unique(ids, return_inverse=True)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block], pa.int64()),
            *(pa.array([_packed(x)], pa.binary()) for x in (np.diff(places, prepend=0), numbers, own_ids)),
            pa.array([own], pa.int32()),
        ],
        RELATION.names,
    )


@dataclass
class _Merged:
    """A block's relation merged with itself: ``places`` and, at each, the ``number`` of a longer phrase; of each
    number the phrases that it begins and ends with, and its own occurrences."""

    block: int
    own: int
    places: np.ndarray
    number: np.ndarray
    front: np.ndarray
    back: np.ndarray
    n: np.ndarray


def _merge(rows: pa.RecordBatch) -> Iterator[_Merged]:
    for block, gaps, phrases, ids, own in zip(*(rows.column(c) for c in RELATION.names), strict=True):
        places, phrases, ids = np.cumsum(_unpacked(gaps.as_py())), _unpacked(phrases.as_py()), _unpacked(ids.as_py())
        own = own.as_py()
        meet = places[1:] == places[:-1] + 1
        pairs = phrases[:-1][meet] * max(1, len(ids)) + phrases[1:][meet]
        places = places[:-1][meet]
        new, number = np.unique(pairs, return_inverse=True)
        yield _Merged(
            block.as_py(),
            own,
            places,
            number,
            ids[new // max(1, len(ids))],
            ids[new % max(1, len(ids))],
            np.bincount(number[places < own], minlength=len(new)),
        )


def split_words(text: bytes | None) -> Iterator[tuple[bytes, int, list[bytes]]]:
    """A prepared text and its words, part by part with where the part begins: line feeds where pieces end, and
    empty words, which stand for nothing."""
    data = (text or b"").translate(_BYTES).replace(_END, b" \n ")
    begin = 0
    while begin <= len(data):
        end = data.find(b" ", begin + PART_BYTES)
        end = len(data) if end < 0 else end
        yield data, begin, data[begin:end].split(b" ")
        begin = end + 1


def _next_words(data: bytes, at: int, count: int) -> list[bytes]:
    """The next words of a piece, from a byte on."""
    out: list[bytes] = []
    while len(out) < count and at < len(data):
        end = data.find(b" ", at)
        word = data[at : len(data) if end < 0 else end]
        if word == _END:
            break
        if word:
            out.append(word)
        at += len(word) + 1
    return out


class _Known(dict):
    """Ids of frequent words; a word that is none has none."""

    def __missing__(self, word: bytes) -> int:
        return RARE


EMPTY, RARE, END = -3, -2, -1


class _Numbers(dict):
    """Numbers of all words of a block, given when first asked for."""

    def __init__(self, lang: str, words: list[tuple[str, bytes]]):
        super().__init__({b"": EMPTY, _END: END})
        self.lang, self.words = lang, words

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append((self.lang, word))
        return number


class _Block:
    """Places gathered so far, and the numbers that words have."""

    def __init__(self, number: int, known: dict[str, _Known] | None):
        self.number, self.parts, self.size = number, [], 0
        self.words: list[tuple[str, bytes]] = []
        self.of = {} if known is None else known
        self.is_known = known is not None

    def add(self, lang: str, words: list[bytes]) -> None:
        of = self.of.get(lang)
        if of is None:
            of = self.of[lang] = _Known({b"": EMPTY, _END: END}) if self.is_known else _Numbers(lang, self.words)
        codes = np.fromiter(map(of.__getitem__, words), "i8", len(words))
        codes = codes[codes > EMPTY]
        self.parts.append(codes)
        self.size += len(codes)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        codes = np.concatenate([*self.parts, np.zeros(0, "i8")])
        at = np.flatnonzero(codes >= 0)
        return at, codes[at]


def _dealt(batches: Iterator[pa.RecordBatch], block_words: int, max_words: int, known=None) -> Iterator[tuple[_Block, int]]:
    """Blocks of a task's texts, each with how many of its places are its own."""
    block = _Block(TaskContext.get().partitionId() << 32, known)
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang = lang.as_py()
            for data, begin, words in split_words(text.as_py()):
                at = 0
                while len(words) - at > (room := max(0, block_words - block.size)):
                    block.add(lang, words[at : at + room])
                    at += room
                    if block.size < block_words:  # some were empty
                        continue
                    own, seen = block.size, begin + at + sum(map(len, words[:at]))
                    block.add(lang, _next_words(data, seen, max_words - 1))
                    yield block, own
                    block = _Block(block.number + 1, known)
                block.add(lang, words[at:])
            block.add(lang, [_END])
    yield block, block.size


def word_counts(texts: DataFrame) -> DataFrame:
    """``lang, word, n`` of all words; each task adds up what it sees, some ``COUNTED_WORDS`` at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, of in counts.items():
                of.pop(b"", None)
                of.pop(_END, None)
                words, n = list(of), list(of.values())
                for k in range(0, len(words), 50_000):
                    some = words[k : k + 50_000]
                    columns = [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()), pa.array(n[k : k + 50_000], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                of = counts.setdefault(lang.as_py(), Counter())
                for _, _, words in split_words(text.as_py()):
                    of.update(words)
            if sum(map(len, counts.values())) > COUNTED_WORDS:
                yield from flush()
        yield from flush()

    rows = texts.mapInArrow(count, "lang string, word binary, n long")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("a"))


def word_relation(texts: DataFrame, frequent: DataFrame, block_words: int, max_words: int, is_small: bool) -> DataFrame:
    """The relation of frequent words."""
    if is_small:
        rows = frequent.select("lang", "word", "id").toArrow()
        found: dict[str, dict[bytes, int]] = {}
        for lang, word, at in zip(*(rows.column(c).to_pylist() for c in ("lang", "word", "id")), strict=True):
            found.setdefault(lang, {b"": EMPTY, _END: END})[word] = at
        shared = texts.sparkSession.sparkContext.broadcast(found)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = {lang: _Known(of) for lang, of in shared.value.items()}
            for block, own in _dealt(batches, block_words, max_words, known):
                yield _relation_row(block.number, *block.places(), own)

        return texts.mapInArrow(deal, RELATION)

    more = (("number", T.LongType()), ("lang", T.StringType()), ("word", T.BinaryType()))
    words = T.StructType([*RELATION.fields, *(T.StructField(*m) for m in more)])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The relation of all words, by number in the block, and a row for each of these."""
        for block, own in _dealt(batches, block_words, max_words):
            row = _relation_row(block.number, *block.places(), own)
            none = [pa.nulls(1, kind) for kind in (pa.int64(), pa.string(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*row.columns, *none], words.names)
            numbers = np.arange(len(block.words))
            for k in range(0, len(numbers), 50_000):
                some = numbers[k : k + 50_000]
                langs, spelled = zip(*block.words[k : k + 50_000], strict=True)
                columns = [
                    pa.array(np.full(len(some), block.number)),
                    *(pa.nulls(len(some), pa.binary()) for _ in range(3)),
                    pa.nulls(len(some), pa.int32()),
                    pa.array(some, pa.int64()),
                    pa.array(langs, pa.string()),
                    pa.array(spelled, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, words.names)

    table = stored(texts.mapInArrow(number, words), "collocation-words")
    own = table.filter(F.col("word").isNotNull()).select(F.col("block").alias("at"), "number", "lang", "word")
    found = own.join(frequent.select("id", "lang", "word"), ["lang", "word"]).select("at", "number", "id")
    relation = table.filter(F.col("word").isNull()).select(*RELATION.names)

    def keep(relation: pa.Table, frequent: pa.Table) -> pa.Table:
        if not relation.num_rows:
            return pa.Table.from_batches([], _ARROW_RELATION)
        row = relation.slice(0, 1).to_pylist()[0]
        places, number, ids = np.cumsum(_unpacked(row["gaps"])), _unpacked(row["phrases"]), _unpacked(row["ids"])
        number = ids[number]
        numbers = frequent.column("number").to_numpy()
        id_of = np.full(int(max(ids.max(initial=0), numbers.max(initial=0))) + 1, -1, "i8")
        id_of[numbers] = frequent.column("id").to_numpy()
        stays = id_of[number] >= 0
        return pa.Table.from_batches([_relation_row(row["block"], places[stays], id_of[number[stays]], row["own"])])

    return relation.groupBy("block").cogroup(found.groupBy("at")).applyInArrow(keep, RELATION)


_ARROW_RELATION = pa.schema(
    [
        ("block", pa.int64()),
        ("gaps", pa.binary()),
        ("phrases", pa.binary()),
        ("ids", pa.binary()),
        ("own", pa.int32()),
    ]
)


def _bucket_of(front: np.ndarray, back: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = mix(front.astype("u8") * np.uint64(0x9E3779B97F4A7C15) ^ mix(back.astype("u8")))
    return (mixed % np.uint64(buckets)).astype("i8")


def pair_counts(relation: DataFrame, buckets: int, min_count: int) -> DataFrame:
    """``id, front, back, a`` of the frequent phrases that are one word longer than those of ``relation``.

    A block's distinct phrases go to ``buckets`` by hash, packed as lists, and are added up there.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for got in _merge(batch):
                bucket = _bucket_of(got.front, got.back, buckets)
                order = np.argsort(bucket, kind="stable")
                numbers, begins = np.unique(bucket[order], return_index=True)
                columns = [pa.array(numbers, pa.int64())]
                for x in (got.front, got.back, got.n):
                    parts = np.split(x[order], begins[1:]) if len(begins) else []
                    columns.append(pa.array([_packed(p) for p in parts], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "front", "back", "n"])

    def add(rows: pa.Table) -> pa.Table:
        front, back, n = (np.concatenate([_unpacked(x.as_py()) for x in rows.column(c)]) for c in ("front", "back", "n"))
        order = np.lexsort((back, front))
        front, back = front[order], back[order]
        first = np.flatnonzero(np.append(True, (front[1:] != front[:-1]) | (back[1:] != back[:-1])))
        a = np.add.reduceat(n[order], first)
        some = first[a >= min_count]
        ids = (rows.column("bucket")[0].as_py() << 32) + np.arange(len(some))
        return pa.table({"id": ids, "front": front[some], "back": back[some], "a": a[a >= min_count]})

    rows = relation.mapInArrow(count, "bucket long, front binary, back binary, n binary")
    return rows.groupBy("bucket").applyInArrow(add, "id long, front long, back long, a long")


def longer_relation(relation: DataFrame, frequent: DataFrame, is_small: bool) -> DataFrame:
    """The relation of the ``frequent`` phrases that are one word longer than those of ``relation``."""
    if is_small:
        rows = frequent.select("front", "back", "id").toArrow()
        shared = relation.sparkSession.sparkContext.broadcast(tuple(rows.column(c).to_numpy() for c in ("front", "back", "id")))

        def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            front, back, ids = shared.value
            fronts, backs = np.unique(front), np.unique(back)
            codes = np.searchsorted(fronts, front) * max(1, len(backs)) + np.searchsorted(backs, back)
            order = np.argsort(codes)
            codes, ids = codes[order], ids[order]
            for batch in batches:
                for got in _merge(batch):
                    id_of = np.full(len(got.front), -1, "i8")
                    if len(codes) and len(id_of):
                        at_f = np.minimum(np.searchsorted(fronts, got.front), len(fronts) - 1)
                        at_b = np.minimum(np.searchsorted(backs, got.back), len(backs) - 1)
                        own = at_f * len(backs) + at_b
                        at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
                        found = (codes[at] == own) & (fronts[at_f] == got.front) & (backs[at_b] == got.back)
                        id_of[found] = ids[at[found]]
                    yield _kept(got, id_of)

        return relation.mapInArrow(extend, RELATION)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for got in _merge(batch):
                for k in range(0, len(got.front), 50_000):
                    some = slice(k, k + 50_000)
                    numbers = np.arange(len(got.front))[some]
                    columns = [np.full(len(numbers), got.block), numbers, got.front[some], got.back[some]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["at", "number", "front", "back"])

    def keep(relation: pa.Table, frequent: pa.Table) -> pa.Table:
        for got in itertools.chain.from_iterable(map(_merge, relation.to_batches())):
            id_of = np.full(len(got.front), -1, "i8")
            id_of[frequent.column("number").to_numpy()] = frequent.column("id").to_numpy()
            return pa.Table.from_batches([_kept(got, id_of)])
        return pa.Table.from_batches([], _ARROW_RELATION)

    told = relation.mapInArrow(tell, "at long, number long, front long, back long")
    found = told.join(frequent.select("id", "front", "back"), ["front", "back"]).select("at", "number", "id")
    return relation.groupBy("block").cogroup(found.groupBy("at")).applyInArrow(keep, RELATION)


def _kept(got: _Merged, id_of: np.ndarray) -> pa.RecordBatch:
    """What is left of a merged relation: the phrases that have an id."""
    ids = id_of[got.number]
    stays = ids >= 0
    return _relation_row(got.block, got.places[stays], ids[stays], got.own)


def candidates(
    docs: DataFrame,
    text_column: str = "text",
    lang_column: str = "lang",
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    block_words: int = BLOCK_WORDS,
    broadcast_phrases: int = BROADCAST_PHRASES,
) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases by length from 1, and ``lang, n``: all words of each language.

    A phrase has ``id, lang, phrase, last`` (its last word), ``a``, ``fronts`` and ``backs`` (counts of its
    beginnings and ends of 1, 2, ... words, itself included), and from two words on ``front`` and ``back``, the
    ids of its beginning and end that are one word shorter.
    """
    if max_words < 2:
        raise ValueError("a phrase has two words or more")
    texts = docs.select(
        F.coalesce(lang_column, F.lit(NO_LANGUAGE)).cast("string").alias("lang"), F.col(text_column).cast("binary").alias("text")
    )
    counts = stored(word_counts(texts), "collocation-counts")
    sizes = stored(counts.groupBy("lang").agg(F.sum("a").alias("n")), "collocation-sizes")
    frequent = counts.filter(F.col("a") >= min_count).withColumn("id", F.monotonically_increasing_id())
    frequent = stored(frequent, "collocation-frequent")
    discard(counts)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, (sizes.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS)
    relation = stored(
        word_relation(texts, frequent, block_words, max_words, frequent.count() <= broadcast_phrases), "collocation-relation"
    )
    word = F.col("word").cast("string")
    lengths = [
        frequent.select(
            "id", "lang", word.alias("phrase"), word.alias("last"), "a", F.array("a").alias("fronts"), F.array("a").alias("backs")
        )
    ]
    for size in range(2, max_words + 1):
        frequent = stored(pair_counts(relation, buckets, min_count), "collocation-frequent")
        left = lengths[-1].select(F.col("id").alias("front"), "lang", F.col("phrase").alias("begins"), "fronts")
        right = lengths[-1].select(F.col("id").alias("back"), "last", "backs")
        named = frequent.join(left, "front").join(right, "back")
        found = named.select(
            "id",
            "lang",
            F.concat_ws(" ", "begins", "last").alias("phrase"),
            "last",
            "a",
            F.concat("fronts", F.array("a")).alias("fronts"),
            F.concat("backs", F.array("a")).alias("backs"),
            "front",
            "back",
        )
        lengths.append(stored(found, "collocation-lengths"))
        if size < max_words:
            before = relation
            is_small = frequent.count() <= broadcast_phrases
            relation = stored(longer_relation(relation, frequent, is_small), "collocation-relation")
            discard(before)
        discard(frequent)
    discard(relation)
    return lengths, sizes


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)) in whole numbers of up to 38 digits."""
    whole = [x.cast("decimal(38,0)") for x in (a, n, left, right)]
    over, under = F.lit(1000).cast("decimal(38,0)") * whole[0] * whole[1], whole[2] * whole[3]
    # the quotient's whole part: take away the rest, then the division is exact
    return ((over - over % under) / under).cast("bigint")


def mine(
    docs: DataFrame,
    text_column: str = "text",
    lang_column: str = "lang",
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    keep_share: int = KEEP_SHARE,
    block_words: int = BLOCK_WORDS,
    broadcast_phrases: int = BROADCAST_PHRASES,
) -> DataFrame:
    """All phrases of two words or more that are no part of a longer one as frequent: ``lang, phrase, a, l, r, n,
    score`` with the cut that scores lowest."""
    lengths, sizes = candidates(docs, text_column, lang_column, max_words, min_count, block_words, broadcast_phrases)
    kept = None
    for size in range(2, max_words + 1):
        own = lengths[size - 1].select("id", "lang", "phrase", "a", "fronts", "backs")
        if size < max_words:
            longer = lengths[size]
            inside = longer.select(F.col("front").alias("id"), F.col("a").alias("longer")).unionByName(
                longer.select(F.col("back").alias("id"), F.col("a").alias("longer"))
            )
            most = inside.groupBy("id").agg(F.max("longer").alias("longer"))
            own = own.join(most, "id", "left").filter(
                F.col("longer").isNull() | (100 * F.col("longer") < keep_share * F.col("a"))
            )
        own = own.join(sizes, "lang")
        cuts = F.array(
            *[
                F.struct(
                    _score(F.col("a"), F.col("n"), left := F.col("fronts")[k - 1], right := F.col("backs")[size - k - 1]).alias("score"),
                    F.lit(k).alias("k"),
                    left.alias("l"),
                    right.alias("r"),
                )
                for k in range(1, size)
            ]
        )
        scored = own.select("lang", "phrase", "a", "n", F.array_min(cuts).alias("cut"))
        rows = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
        kept = rows if kept is None else kept.unionByName(rows)
    return kept


def top(phrases: DataFrame, count: int = TOP) -> DataFrame:
    """The first ``count`` phrases of each language with their ``rank``. Each task passes on as many at most."""
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return phrases.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= count)
