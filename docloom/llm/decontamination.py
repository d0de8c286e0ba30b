"""Benchmark decontamination with a generalised suffix automaton.

The words of all test items, A-Z lowered and anything but letters, digits and non-ASCII characters
taken as a break, make one automaton. The words of a document stream through it; at each word it knows
the longest run ending there that occurs in some item. A run of ``window`` words or more is a hit as a
whole, since each window in it is an item's. An item of fewer words is a hit only as a whole.

A document is one row and read once, in a narrow pass; runs of words that no item has are skipped
without a step. Items are gathered by slices of about ``SLICE_WORDS`` words, so what is broadcast has
a bound; a larger benchmark takes one pass for each slice, with a written table between passes.

Null text has no words. An item without words, or null, contributes nothing; an item whose id is null
marks words but is not listed. Repeated items and repeated documents are treated row by row, an item
id is listed once. Other columns of the documents are carried along. Empty tables give no hits and no
rows.
"""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.tables import ascii_lower, stored
from docloom.llm.workers import begin

WINDOW = 10
SLICE_WORDS = 200_000
#: A document more of whose words are hit goes as a whole.
MAX_COVERAGE = 0.5

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # in text that is not lowered
_BREAK = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c > 127 else 32 for c in range(256))
_TABLE = bytes(_BREAK[ord(chr(c).lower())] if c < 128 else c for c in range(256))

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    """Normalised words as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class Automaton:
    """States by number; 0 is the start. ``length`` is that of a state's longest run of words."""

    window: int = WINDOW
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    steps: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: State of a run to the state of its last ``window`` words, and the items that have those.
    of_window: list[int] = field(default_factory=list)
    items: dict[int, frozenset[str]] = field(default_factory=dict)
    #: State to the short items that end its runs: (words, ids).
    short: dict[int, tuple[tuple[int, frozenset[str]], ...]] = field(default_factory=dict)
    shortest: int = WINDOW

    @classmethod
    def of(cls, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Automaton:
        """Build from (id, text) of all items."""
        made = cls(window, shortest=window)
        lists = []
        for item, text in items:
            ids = [made.vocabulary.setdefault(w, len(made.vocabulary)) for w in words_of(text)]
            if ids:
                lists.append((item, ids))
                last = 0
                for word in ids:
                    last = made._extend(last, word)
        made._mark(lists)
        return made

    def _new(self, length: int, link: int, steps: dict[int, int]) -> int:
        self.steps.append(steps)
        self.link.append(link)
        self.length.append(length)
        return len(self.steps) - 1

    def _split(self, at: int, word: int, target: int) -> int:
        """The state for the runs of ``target`` that extend those of ``at``."""
        if self.length[target] == self.length[at] + 1:
            return target
        part = self._new(self.length[at] + 1, self.link[target], dict(self.steps[target]))
        self.link[target] = part
        while at >= 0 and self.steps[at].get(word) == target:
            self.steps[at][word] = part
            at = self.link[at]
        return part

    def _extend(self, last: int, word: int) -> int:
        known = self.steps[last].get(word)
        if known is not None:  # an earlier item has this run
            return self._split(last, word, known)
        new = self._new(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.steps[at]:
            self.steps[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word, self.steps[at][word])
        return new

    def _mark(self, lists: list[tuple[str | None, list[int]]]) -> None:
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.of_window = [0] * len(order)
        for state in order[1:]:
            if self.length[state] >= self.window:
                up = self.link[state]
                self.of_window[state] = state if self.length[up] < self.window else self.of_window[up]
        having: dict[int, set[str]] = {}
        ending: dict[int, dict[int, set[str]]] = {}
        for item, ids in lists:
            names = {item} - {None}
            state = 0
            for n, word in enumerate(ids, 1):
                state = self.steps[state][word]
                if n >= self.window:
                    having.setdefault(self.of_window[state], set()).update(names)
            if len(ids) < self.window:
                self.shortest = min(self.shortest, len(ids))
                ending.setdefault(state, {}).setdefault(len(ids), set()).update(names)
        self.items = {s: frozenset(x) for s, x in having.items()}
        if ending:
            for state in order[1:]:
                own = tuple((n, frozenset(x)) for n, x in ending.get(state, {}).items())
                if ends := own + self.short.get(self.link[state], ()):
                    self.short[state] = ends

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Hit spans of words, [first, behind the last], merged and in order; and the items hit."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.concatenate(([0], (ids >= 0).astype(np.int8), [0]))
        edges = np.flatnonzero(np.diff(known))
        spans: list[list[int]] = []
        items: set[str] = set()
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - begin >= self.shortest:
                self._scan_run(ids[begin:end].tolist(), begin, spans, items)
        return spans, items

    def _scan_run(self, ids: list[int], offset: int, spans: list[list[int]], items: set[str]) -> None:
        steps, link, length, window, short = self.steps, self.link, self.length, self.window, self.short
        state = matched = 0
        for place, word in enumerate(ids, offset + 1):
            to = steps[state].get(word)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = steps[state].get(word)
            if to is None:
                continue
            state = to
            matched += 1
            hit = 0
            if matched >= window:
                hit = matched
                items |= self.items[self.of_window[state]]
            if state in short:
                for n, names in short[state]:
                    if n <= matched:
                        hit = max(hit, n)
                        items |= names
            if hit:
                begin = place - hit
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append([begin, place])


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for begin, end in sorted(map(list, spans)):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return out


def slices(benchmark: DataFrame, id_column: str, text_column: str, words: int) -> list[DataFrame]:
    """The distinct items in parts of about ``words`` words, dealt by a hash."""
    items = benchmark.select(
        F.col(id_column).cast("string").alias("item"), F.col(text_column).alias("text")
    ).filter(F.col("text").isNotNull())
    count = F.size(F.split(ascii_lower("text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    total = items.agg(F.sum(count)).first()[0] or 0
    n = max(1, math.ceil(total / words))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [items.filter(part == k).distinct() for k in range(n)]


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW,
    slice_words: int = SLICE_WORDS,
    found: str = "found",
) -> DataFrame:
    """``docs`` with a struct ``found``: ``n_words``, ``n_hit``, ``spans`` (of words, from 0, end
    excluded) and ``items`` (ids as strings, sorted)."""
    out = docs
    parts = slices(benchmark, item_column, item_text_column, slice_words)
    for k, part in enumerate(parts):
        rows = [(r.item, r.text) for r in part.collect()]
        shared = docs.sparkSession.sparkContext.broadcast(Automaton.of(rows, window))
        before = F.lit(None).cast(FOUND) if k == 0 else F.col(found)
        out = out.withColumn(found, _finder(shared)(F.col(text_column), before))
        if k + 1 < len(parts):
            out = stored(out, "benchmark-pass")
    return out


def _finder(shared):
    def scan(texts, before):
        import pandas as pd

        begin("decontamination")
        automaton, rows = shared.value, []
        for text, spans, items in zip(texts, before["spans"], before["items"], strict=True):
            words = words_of(text)
            new_spans, new_items = automaton.scan(words)
            if items is not None:
                new_spans, new_items = merged([*new_spans, *spans]), new_items | set(items)
            rows.append((len(words), sum(b - a for a, b in new_spans), new_spans, sorted(new_items)))
        return pd.DataFrame(rows, columns=FOUND.names)

    return F.pandas_udf(scan, FOUND)


def without_spans(text: str, spans: list[list[int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for begin, end in spans:
        kept.append(text[at : places[begin][0]])
        at = places[end - 1][1]
    return "".join([*kept, text[at:]])


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_column: str = "text",
    min_words: int = 1,
    max_coverage: float = MAX_COVERAGE,
    window: int = WINDOW,
    slice_words: int = SLICE_WORDS,
    **names: str,
) -> DataFrame:
    """``docs`` without the hit spans of ``min_words`` words or more; a document of which more than
    ``max_coverage`` is hit, or of which nothing but hits is left, goes.

    What is left is searched again until nothing is found, as words on both sides of a removed span
    become neighbours. Rows without a hit keep their text to the letter.
    """
    columns = docs.columns
    cut = F.pandas_udf(_cut, T.StringType())
    share = F.col("_found.n_hit") / F.greatest(F.col("_found.n_words"), F.lit(1))
    long = F.filter("_found.spans", lambda s: s[1] - s[0] >= min_words)
    rest, done = docs, []
    while True:
        marked = find(rest, benchmark, text_column, window=window, slice_words=slice_words, found="_found", **names)
        marked = stored(marked.filter(share <= max_coverage).withColumn("_long", long), "decontaminated")
        done.append(marked.filter(F.size("_long") == 0).select(*columns))
        dirty = marked.filter(F.size("_long") > 0)
        if dirty.limit(1).count() == 0:
            return functools.reduce(DataFrame.unionAll, done)
        # only what was cut is looked at again
        rest = dirty.withColumn(text_column, cut(F.col(text_column), F.col("_long"))).select(*columns)


def _cut(texts, spans):
    import pandas as pd

    return pd.Series([without_spans(t, s) if t is not None and len(s) else t for t, s in zip(texts, spans, strict=True)])
