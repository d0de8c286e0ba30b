"""Language identification by bit-sliced Bloom filters over character n-grams.

Learning counts the character n-grams of each language in Spark and keeps for a language those that
make up at least ``MIN_RATE`` of its n-grams, so no more than ``1 / MIN_RATE`` of them. All languages
share one Bloom filter of bit masks: place *p* holds one bit per language, and the conjunction of the
masks at an n-gram's places is the set of languages that contain it. A text's n-grams are looked up at
once; each language's count of hits, corrected for the share that its bits give by chance, decides.

Texts are lowered, runs of anything but letters become one blank, and a text is framed by blanks.
Null text, or text without a letter, is ``und`` with score 0. A text none of whose n-grams is known
gets the language with the most learned rows and score 0; ties between languages go to the first by
name. Rows with a null or empty language teach nothing; with nothing to learn from, every text is
``und``. Null and repeated ids are judged row by row, whole texts are read in parts of
``PART_CHARS``, and other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.workers import begin

#: Rows that are learned from, at most (as expected by a hash): a bound on the work of fitting.
TRAIN_ROWS = 20_000
SIZES = (3, 4)
MIN_RATE = 2e-5
PLACES = 1 << 21
HASHES = 2
MAX_LANGUAGES = 64
PART_CHARS = 1 << 20
ROWS_AT_ONCE = 500
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], "u8")


def letters_only(text: str | None) -> str:
    """Lower-cased letters with single blanks between and around; empty if there is no letter."""
    kept = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {kept} " if kept else ""


def gram_hashes(text: str) -> np.ndarray:
    """64-bit hashes of all n-grams of a text that :func:`letters_only` prepared."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    parts = []
    with np.errstate(over="ignore"):
        for n in SIZES:
            if len(codes) < n:
                continue
            h = np.full(len(codes) - n + 1, n, "u8")
            for k in range(n):
                h = (h ^ codes[k : len(codes) - n + 1 + k]) * _MULTIPLIERS[k]
                h ^= h >> np.uint64(29)
            parts.append(h)
    return np.concatenate(parts) if parts else np.zeros(0, "u8")


def text_hashes(text: str | None) -> Iterator[np.ndarray]:
    """Hashes of a whole text in parts of bounded size; an n-gram across a cut is counted once."""
    prepared = letters_only(text)
    overlap = max(SIZES) - 1
    if len(prepared) <= PART_CHARS:
        yield gram_hashes(prepared)
        return
    for at in range(0, len(prepared), PART_CHARS):
        # shorter n-grams inside the overlap come twice; parts are long, so this weighs nothing
        yield gram_hashes(prepared[at : at + PART_CHARS + overlap])


@dataclass(frozen=True)
class Model:
    """Masks by place, language names by bit, chance of a hit by language, and the fallback."""

    masks: np.ndarray
    languages: tuple[str, ...]
    chance: np.ndarray
    fallback: str

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The mask of languages that contain each n-gram."""
        found = np.full(len(hashes), np.iinfo(self.masks.dtype).max, self.masks.dtype)
        for k in range(HASHES):
            found &= self.masks[places_of(hashes, k)]
        return found

    def decide(self, hits: np.ndarray, n: int) -> tuple[str, float]:
        """Language and score from hits per language over ``n`` n-grams."""
        if n == 0 or not len(self.languages):
            return UNKNOWN, 0.0
        share = np.clip((hits / n - self.chance) / np.maximum(1 - self.chance, 1e-9), 0, 1)
        best = int(np.argmax(share))
        if share[best] == 0:
            return self.fallback, 0.0
        return self.languages[best], float(share[best] / share.sum())


def places_of(hashes: np.ndarray, k: int) -> np.ndarray:
    shift = np.uint64(21 * k)
    return ((hashes >> shift) % np.uint64(PLACES)).astype("i8")


def training_rows(docs: DataFrame, rows: int, id_column: str, text_column: str, lang_column: str, learn: Column) -> DataFrame:
    """About ``rows`` of the rows to learn from, chosen by a hash of the id."""
    known = docs.filter(learn & F.col(lang_column).isNotNull() & (F.col(lang_column) != ""))
    share = rows / max(1, known.count())
    dice = F.pmod(F.xxhash64(F.col(id_column)), F.lit(1 << 20))
    return known.filter(dice < int(share * (1 << 20)) + 1).select(
        F.col(lang_column).alias("lang"), F.col(text_column).alias("text")
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct n-gram hashes by language and batch, with their counts."""
    begin("language")
    for whole in batches:
        for batch in (whole.slice(k, ROWS_AT_ONCE) for k in range(0, whole.num_rows, ROWS_AT_ONCE)):
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                seen = [h for i in np.flatnonzero(langs == lang) for h in text_hashes(texts[i])]
                grams, counts = np.unique(np.concatenate(seen), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams)), pa.array(grams.view("i8")), pa.array(counts)],
                    ["lang", "gram", "n"],
                )


def fit(
    docs: DataFrame,
    learn: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    train_rows: int = TRAIN_ROWS,
) -> Model:
    """Learn from the rows of ``docs`` for which ``learn`` holds.

    To the driver come the kept n-grams: at most ``1 / MIN_RATE`` for each language.
    """
    rows = training_rows(docs, train_rows, id_column, text_column, lang_column, learn)
    counted = rows.mapInArrow(_count, "lang string, gram bigint, n bigint")
    totals = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # a language's total, from sums per language; no window gathers a language
    sums = {r.lang: r.n for r in totals.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = tuple(sorted(sums))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    dtype = "u1" if len(languages) <= 8 else "u8"
    masks = np.zeros(PLACES, dtype)
    if languages:
        least = F.create_map(*[F.lit(x) for lang in languages for x in (lang, MIN_RATE * sums[lang])])
        kept = totals.filter(F.col("n") >= F.try_element_at(least, F.col("lang"))).select("lang", "gram").toPandas()
        for bit, lang in enumerate(languages):
            grams = kept.gram[kept.lang == lang].to_numpy("i8").view("u8")
            for k in range(HASHES):
                masks[places_of(grams, k)] |= masks.dtype.type(1 << bit)
    filled = np.array([np.count_nonzero(masks >> b & 1) / PLACES for b in range(len(languages))])
    most = max(sums, key=lambda lang: (sums[lang], lang)) if sums else UNKNOWN
    return Model(masks, languages, filled**HASHES, most)


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to the id and text of ``docs``, in one narrow pass.

    The model is a broadcast of fixed size, ``PLACES`` masks.
    """
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return _beside(narrow, model, 1, 1, "lang_pred", "score")


def predict(docs: DataFrame, model: Model, text_column: str, language: str, score: str) -> DataFrame:
    """All columns of ``docs`` with two more."""
    rows = docs.drop(language, score)
    return _beside(rows, model, len(rows.columns), rows.columns.index(text_column), language, score)


def _beside(rows: DataFrame, model: Model, kept: int, text: int, language: str, score: str) -> DataFrame:
    """The first ``kept`` columns of ``rows``, with language and score of the text in column ``text``.

    Spark holds no rows while the worker reads them, and a worker holds few texts as strings at once.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [*rows.columns[:kept], language, score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("language")
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(k, ROWS_AT_ONCE)
                found = [judge_text(shared.value, t) for t in part.column(text).to_pylist()]
                added = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], *added], names)

    added = [T.StructField(language, T.StringType()), T.StructField(score, T.DoubleType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:kept], *added]))


def judge_text(model: Model, text: str | None) -> tuple[str, float]:
    """Language and score of one text."""
    hits, n = np.zeros(len(model.languages)), 0
    for hashes in text_hashes(text):
        masks = model.lookup(hashes)
        n += len(masks)
        by_mask = np.bincount(masks) if masks.dtype == np.uint8 else None
        for bit in range(len(model.languages)):
            if by_mask is None:
                hits[bit] += np.count_nonzero(masks >> np.uint64(bit) & np.uint64(1))
            else:
                hits[bit] += by_mask[np.arange(len(by_mask)) >> bit & 1 == 1].sum()
    return model.decide(hits, n)
