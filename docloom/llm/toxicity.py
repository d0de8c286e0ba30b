"""Toxicity scores from a learned lexicon, matched with Levenshtein automata.

Learning counts, over labelled documents, in how many toxic and other documents a word or a stem
(``stem*``, for languages that inflect and compound) stands, and keeps as lexicon those that stand in
toxic ones far more often than chance allows. The lexicon is a trie. A word runs through the trie and
the Levenshtein automaton of its terms at once: a state is the set of trie nodes within reach with the
edits spent, made when first needed and kept, so a known beginning costs one lookup a letter. Terms of
``FUZZY_LETTERS`` or more are found with one edit, those of ``LONG_LETTERS`` with two. A learned lexicon
also finds terms with two neighbouring letters swapped, or with look-alikes for any number of letters
(``1d1ot``), each as one edit. A word that other labelled documents use is a word of its own and no
misspelling.

Each hit is read in a window of words: one inside quotation marks, or just behind a word that reports
speech, counts as quotation, others as abuse. Sums of both over the document, weighted by how toxic the
term is, go into a logistic model learned on the same labels. A misspelled hit counts as its term does; only
terms that are beyond chance three times over are looked for misspelled.

A null label teaches nothing; of repeated labels for one id the largest counts; a label for no document
or an id that stands in several documents is joined as it is. Null and empty texts are without hits and
get the score of such a text. With no label, or labels of one kind only, there is no lexicon and the
score is the share of toxic labels. Texts are read whole, in parts of ``PART_CHARS`` cut at white space.
Null and repeated document ids are judged row by row and other columns are carried along.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.packing import text_parts
from docloom.llm.tables import stored
from docloom.llm.workers import begin

#: Labelled rows that are learned from, at most (as expected by a hash): a bound on the work of fitting.
TRAIN_ROWS = 20_000
#: Documents a term must stand in. All that pass the test of chance are terms; the words of ``TRAIN_ROWS`` bound them.
MIN_DOCS = 3
#: A score from which a document counts as toxic.
THRESHOLD = 0.3
#: Words on both sides of a hit that its reading takes in, and words before it that may report it.
CONTEXT, BEFORE = 8, 3
#: Letters of a term from which one edit, and two, are allowed.
FUZZY_LETTERS, LONG_LETTERS = 4, 8
STEM_LETTERS = (5, 6, 7)
PART_CHARS = 1 << 20
#: Texts that a worker holds as Python strings at once.
DOCS_AT_ONCE = 200
#: What a worker remembers: words, steps of the automaton, and trie nodes in its states.
KNOWN_WORDS, KNOWN_STEPS, KNOWN_NODES = 100_000, 200_000, 1_000_000

#: Words that report what others say, in the languages this was written for.
REPORTING = frozenset(
    "said says called quote quoted word words term wrote writes sagte schrieb nannte wort zitat "
    "dit appelé mot écrit citation dijo llamó palabra escribió cita".split()
)
#: Signs that stand for letters.
LOOK_ALIKES = str.maketrans("013457@$", "oieastas")
_QUOTES = "\"“”„«»"
_TOKEN = re.compile(rf"\w[\w@$*]*\w|\w|[{_QUOTES}]")


def edits_for(term: str) -> int:
    """Edits within which a term is still recognised."""
    return (len(term) >= FUZZY_LETTERS) + (len(term) >= LONG_LETTERS)


def with_stems(words: set[str]) -> set[str]:
    """Words, and their first letters as stems."""
    return words | {f"{w[:n]}*" for w in words for n in STEM_LETTERS if len(w) > n}


@dataclass
class Lexicon:
    """Terms and stems with weights, words that are no misspellings, and the trie with its automaton."""

    weights: dict[str, float]
    own_words: frozenset[str] = frozenset()
    disguised: bool = False  # whether swaps and look-alikes count as one edit
    as_written: frozenset[str] = frozenset()  # terms that are found without edits only
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    limits: list[int] = field(default_factory=lambda: [0])  # edits of the terms below a node, at most
    ends: dict[int, str] = field(default_factory=dict)
    stems: dict[int, str] = field(default_factory=dict)
    states: dict[tuple[tuple[int, int], ...], int] = field(default_factory=dict)
    members: list[tuple[tuple[int, int], ...]] = field(default_factory=list)
    moves: dict[tuple[int, str], int] = field(default_factory=dict)
    held: int = 0
    found: dict[str, tuple[str, int] | None] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for term in self.weights:
            node, edits = 0, self.edits(term)
            self.limits[0] = max(self.limits[0], edits)
            for letter in term.removesuffix("*"):
                if letter not in self.children[node]:
                    self.children.append({})
                    self.limits.append(0)
                    self.children[node][letter] = len(self.children) - 1
                node = self.children[node][letter]
                self.limits[node] = max(self.limits[node], edits)
            (self.stems if term.endswith("*") else self.ends)[node] = term
        self.most = self.limits[0]
        self._forget()

    def __getstate__(self) -> dict:
        return {n: getattr(self, n) for n in ("weights", "own_words", "disguised", "as_written")}

    def __setstate__(self, kept: dict) -> None:
        self.__init__(**kept)

    def edits(self, term: str) -> int:
        """Edits within which a term or stem of this lexicon is recognised."""
        return 0 if term.endswith("*") or term in self.as_written else edits_for(term)

    def _forget(self) -> None:
        self.states, self.members, self.moves, self.held = {}, [], {}, 0
        self.start = self._state({0: 0})

    def _state(self, reach: dict[int, int]) -> int:
        """The state of nodes with their least edits, letters of terms left out included."""
        todo = list(reach.items())
        while todo:
            node, edits = todo.pop()
            if edits < self.most and reach[node] == edits:
                for child in self.children[node].values():
                    if self.limits[child] > edits and reach.get(child, self.most + 1) > edits + 1:
                        reach[child] = edits + 1
                        todo.append((child, edits + 1))
        key = tuple(sorted(reach.items()))
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.held += len(key)
        return self.states[key]

    def _move(self, state: int, letter: str) -> int:
        reach: dict[int, int] = {}

        def add(node: int, edits: int) -> None:
            if edits <= self.limits[node] and reach.get(node, self.most + 1) > edits:
                reach[node] = edits

        for node, edits in self.members[state]:
            add(node, edits + 1)  # the word has a letter too many
            for other, child in self.children[node].items():
                add(child, edits + (other != letter))
        return self._state(reach)

    def match(self, word: str) -> tuple[str, int] | None:
        """What a word is in the lexicon, with its edits: the weightiest of the term itself and its
        stems, else the nearest term within reach."""
        whole, near = self._read(word)
        if whole:
            return max(whole, key=lambda t: (self.weights[t], t)), 0
        if self.disguised:
            near += self._swapped(word)
            plain = word.translate(LOOK_ALIKES)
            if plain != word and not word.isdecimal():
                whole, others = self._read(plain)
                near += [(1, term) for term in whole if self.edits(term)]
                near += [(edits + 1, term) for edits, term in others]
        near = [(edits, term) for edits, term in near if edits <= self.edits(term)]
        if not near or word in self.own_words:
            return None
        edits, term = min(near)
        return term, edits

    def _swapped(self, word: str) -> list[tuple[int, str]]:
        """Terms that are the word but for two neighbouring letters, by the trie."""
        found, node = [], 0
        for i in range(len(word) - 1):
            at: int | None = node
            for letter in (word[i + 1], word[i], *word[i + 2 :]):
                at = self.children[at].get(letter)
                if at is None:
                    break
            if at in self.ends:
                found.append((1, self.ends[at]))
            if word[i] not in self.children[node]:
                break
            node = self.children[node][word[i]]
        return found

    def _read(self, word: str) -> tuple[list[str], list[tuple[int, str]]]:
        """Terms and stems that a word is, and the terms that it reaches with edits."""
        if len(self.moves) > KNOWN_STEPS or self.held > KNOWN_NODES:
            self._forget()
        state, whole = self.start, []
        for letter in word:
            to = self.moves.get((state, letter))
            if to is None:
                to = self.moves[state, letter] = self._move(state, letter)
            state = to
            if not self.members[state]:
                break
            whole += [self.stems[n] for n, edits in self.members[state] if edits == 0 and n in self.stems]
        near = [(edits, self.ends[n]) for n, edits in self.members[state] if n in self.ends]
        whole += [term for edits, term in near if edits == 0]
        return whole, [(edits, term) for edits, term in near if edits]

    def hits(self, tokens: list[str]) -> Iterator[tuple[int, str, int]]:
        """Place, term and edits of each hit."""
        found = self.found
        distinct = set(tokens)
        if len(found) + len(distinct) > KNOWN_WORDS:
            found.clear()
        for word in [w for w in distinct if w not in found]:
            found[word] = self.match(word)
        if any(found[w] for w in distinct):
            for place, word in enumerate(tokens):
                if hit := found[word]:
                    yield place, *hit


FEATURES = ("abuse", "quoted", "dense", "heaviest", "terms")


def is_quoted(tokens: list[str], place: int) -> bool:
    """Whether a hit is read as quotation: marks on both sides nearby, or a reporting word before."""
    before = tokens[max(0, place - CONTEXT) : place]
    after = tokens[place + 1 : place + 1 + CONTEXT]
    marks = sum(t in _QUOTES for t in before)
    if marks % 2 == 1 and any(t in _QUOTES for t in after):
        return True
    return any(t in REPORTING for t in before[-BEFORE:])


def features(lexicon: Lexicon, text: str | None) -> list[float]:
    """What a document's hits come to, in the order of ``FEATURES``. A misspelled hit counts as its term does."""
    abuse = quoted = heaviest = 0.0
    words = hits = 0
    terms: set[str] = set()
    for part in text_parts(text or "", PART_CHARS):
        tokens = _TOKEN.findall(part.lower())
        words += len(tokens)
        for place, term, _ in lexicon.hits(tokens):
            weight = lexicon.weights[term]
            if is_quoted(tokens, place):
                quoted += weight
                continue
            hits += 1
            terms.add(term)
            abuse += weight
            heaviest = max(heaviest, weight)
    dense = 100 * hits / max(words, 20)
    return [math.log1p(abuse), math.log1p(quoted), math.log1p(dense), heaviest, math.log1p(len(terms))]


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: np.ndarray  # of FEATURES
    bias: float

    def score(self, text: str | None) -> float:
        at = float(np.dot(self.weights, features(self.lexicon, text)) + self.bias)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, at))))


#: What the weights of ``FEATURES`` are held to as far as labels do not tell: hits count, quoted ones a little
#: against.
PRIOR = np.array([1.0, -0.3, 0.0, 0.0, 0.0])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model by Newton's method, held to ``PRIOR`` but for the bias."""
    x1 = np.column_stack([x, np.ones(len(x))])
    hold = np.append(np.full(x.shape[1], ridge), 1e-6)
    prior = np.append(PRIOR, 0.0)
    w = prior.copy()

    def loss(at: np.ndarray) -> float:
        z = x1 @ at
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(hold * (at - prior) ** 2))

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -500, 500)))
        curve = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(hold)
        step = np.linalg.solve(curve, x1.T @ (y - p) - hold * (w - prior))
        # a whole step may overshoot far from the optimum; the loss is convex, so a shorter one helps
        while (then := loss(w + step)) > now and np.abs(step).max() > 1e-12:
            step = step / 2
        w, before, now = w + step, now, min(now, then)
        if before - now < 1e-9:
            break
    return w[:-1], float(w[-1])


def labelled(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    rows: int,
    id_column: str,
    text_column: str,
    label_column: str,
) -> DataFrame:
    """``toxic`` and ``text`` of about ``rows`` labelled documents, chosen by a hash of the id.

    The labels are cut to that number before the join, so they fit into a broadcast.
    """
    known = (
        labels.select(F.col(id_column).alias("doc_id"), F.col(label_column).alias("toxic"))
        .filter(learn & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg((F.max("toxic") >= 1).cast("int").alias("toxic"))
    )
    share = rows / max(1, known.count())
    dice = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    some = F.broadcast(known.filter(dice < int(share * (1 << 20)) + 1))
    texts = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text"))
    return texts.join(some, "doc_id").select("toxic", "text")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The label and each distinct word of a document."""
    begin("toxicity")
    for batch in batches:
        for k in range(0, batch.num_rows, DOCS_AT_ONCE):
            part = batch.slice(k, DOCS_AT_ONCE)
            flags, words = [], []
            for toxic, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                seen: set[str] = set()
                for piece in text_parts(text, PART_CHARS):
                    seen.update(_TOKEN.findall(piece.lower()))
                seen = with_stems(seen)
                words.extend(seen)
                flags.extend([toxic] * len(seen))
            yield pa.RecordBatch.from_arrays([pa.array(flags, pa.int32()), pa.array(words, pa.string())], ["toxic", "word"])


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Words and stems of ``rows(toxic, text)`` that stand in toxic documents beyond chance, with log odds.

    A word in ``n`` documents, ``t`` of them toxic, is beyond chance if the Chernoff bound of that is
    less than one in the number of words tried.
    """
    counts = (
        rows.mapInArrow(_words, "toxic int, word string")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"))
    )
    counts = stored(counts, "toxic-words")
    of_all = counts.agg(
        F.sum("n").alias("n"), F.sum("t").alias("t"), F.count_if(F.col("n") >= MIN_DOCS).alias("tried")
    ).first()
    if not of_all.n or not of_all.t or of_all.t == of_all.n:
        return Lexicon({})
    by_chance = of_all.t / of_all.n
    share = F.col("t") / F.col("n")
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - by_chance))).otherwise(0.0)
    surprise = F.col("n") * (share * F.log(share / by_chance) + rest)
    odds = F.log((F.col("t") + 0.5) / (F.col("n") - F.col("t") + 0.5)) - math.log(by_chance / (1 - by_chance))
    told = (
        counts.filter((F.col("t") >= MIN_DOCS) & (share > by_chance) & ~F.col("word").isin(list(_QUOTES)))
        .select("word", odds.alias("odds"), surprise.alias("surprise"))
        .filter(F.col("surprise") > math.log(max(2, of_all.tried)))
    )
    kept = [r for r in told.collect() if r.odds > 0]
    # a misspelling is a guess, made for terms that are beyond chance three times over
    as_written = frozenset(r.word for r in kept if r.surprise < 3 * math.log(max(2, of_all.tried)))
    terms = Lexicon({r.word: r.odds for r in kept}, disguised=True, as_written=as_written)
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        for batch in batches:
            words = [w for w in batch.column(0).to_pylist() if (hit := shared.value.match(w)) and hit[1]]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], ["word"])

    # words within the edits of a term: few, as the terms are
    others = counts.filter((F.col("n") - F.col("t") >= MIN_DOCS) & ~F.col("word").endswith("*"))
    own = others.select("word").mapInArrow(near, "word string").collect()
    return Lexicon(terms.weights, frozenset(r.word for r in own), True, as_written)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    train_rows: int = TRAIN_ROWS,
) -> Model:
    """Learn from the labels for which ``learn`` holds; it is asked of ``doc_id``.

    To the driver come the lexicon and six numbers for each of the ``train_rows``.
    """
    rows = stored(labelled(docs, labels, learn, train_rows, id_column, text_column, label_column), "labelled")
    lexicon = learn_lexicon(rows)
    table = _beside(rows.select("toxic", "text"), lexicon, features, "x", pa.list_(pa.float64())).toPandas()
    if not len(table):
        return Model(lexicon, np.zeros(len(FEATURES)), -40.0)
    y = table.toxic.to_numpy(float)
    if y.min() == y.max():
        return Model(lexicon, np.zeros(len(FEATURES)), 40.0 if y[0] else -40.0)
    return Model(lexicon, *logistic(np.array(table.x.tolist(), float), y))


def _beside(
    rows: DataFrame, model, judge, column: str, kind: pa.DataType, kept: int = 1, text: int = 1
) -> DataFrame:
    """The first ``kept`` columns of ``rows`` with what ``judge(model, text)`` says of the text in column ``text``.

    Spark holds no rows while the worker reads them, and a worker holds few texts as strings at once.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [*rows.columns[:kept], column]
    given = T.DoubleType() if kind == pa.float64() else T.ArrayType(T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        for batch in batches:
            for k in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(k, DOCS_AT_ONCE)
                judged = pa.array([judge(shared.value, t) for t in part.column(text).to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], judged], names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:kept], T.StructField(column, given)]))


def scores(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id and the score of each text, for those who need no other column; texts do not come back."""
    return _beside(docs.select(id_column, text_column), model, Model.score, "score", pa.float64())


def score(docs: DataFrame, model: Model, text_column: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the score of each text, 0 to 1, in one narrow pass."""
    rows = docs.drop(column)
    return _beside(rows, model, Model.score, column, pa.float64(), len(rows.columns), rows.columns.index(text_column))
