"""License scans by diagonal voting.

All rolling word pairs of all documents are hashed and joined to the places of the same pairs in a set
of templates. A match votes for the diagonal *document place - template place*; a text that follows a
template keeps to one diagonal, and steps to a neighbouring one where a word was added or dropped.
Diagonals of one document and template at most ``GAP`` apart are merged, and a merged span is verified
if its votes cover ``MIN_COVER`` of the template's pairs. A place where a phrase stands to the word is
a diagonal with all of the phrase's votes.

Pairs are joined before anything is shuffled; what moves are matches only, reduced to one row for each
document, template and diagonal. The templates are broadcast up to ``BROADCAST_PAIRS`` pairs, and left
to Spark's own choice of join beyond.

Words are runs of a-z, 0-9 and non-ASCII characters, A-Z lowered. Null text counts as empty, without
words or labels and with score 0. Rows are told apart by id and text, so repeated rows give repeated
results and a null id is an id like others. Other columns are not looked at. An empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.tables import ascii_lower

GAP = 4
MIN_COVER = 0.75
BROADCAST_PAIRS = 100_000
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``words`` in normal form, two at least. An exact one counts its word-for-word places."""

    label: str
    words: str
    exact: bool = False


#: Phrases whose exact places are asked for.
PHRASES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)

#: Openings of well-known license notices.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
)


def words_of(text: str | Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def _pairs(words: str | Column) -> Column:
    """Hashes of neighbouring words, in order."""
    return F.when(
        F.size(words) >= 2,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1))
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def template_table(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """One row for each pair of each template: ``pair, template, label, exact, at, size``."""
    short = [t for t in templates if len(t.words.split()) < 2]
    if short:
        raise ValueError(f"a template has two words at least: {short[0].label}")
    rows = [(i, t.label, t.exact, t.words.split()) for i, t in enumerate(templates)]
    table = spark.createDataFrame(rows, "template int, label string, exact boolean, words array<string>")
    return table.select(
        "template", "label", "exact", (F.size("words") - 1).alias("size"), F.posexplode(_pairs("words")).alias("at", "pair")
    )


def diagonals(
    docs: DataFrame,
    templates: tuple[Template, ...],
    id_column: str = "doc_id",
    text_column: str = "text",
    broadcast_pairs: int = BROADCAST_PAIRS,
) -> DataFrame:
    """Votes: ``doc_id, text_hash, template, label, exact, size, diagonal`` and ``at``, the places of
    the template that voted."""
    keyed = docs.select(
        F.col(id_column).alias("doc_id"),
        F.xxhash64(text_column).alias("text_hash"),
        _pairs_of_text(text_column).alias("pairs"),
    )
    pairs = keyed.select("doc_id", "text_hash", F.posexplode("pairs").alias("place", "pair"))
    table = template_table(docs.sparkSession, templates)
    if sum(len(t.words.split()) - 1 for t in templates) <= broadcast_pairs:
        table = F.broadcast(table)
    votes = pairs.join(table, "pair").withColumn("diagonal", F.col("place") - F.col("at"))
    return votes.groupBy("doc_id", "text_hash", "template", "label", "exact", "size", "diagonal").agg(
        F.collect_set("at").alias("at")
    )


def _pairs_of_text(text_column: str) -> Column:
    # one higher-order step over the words, so that they are split once
    return F.get(F.transform(F.array(words_of(text_column)), _pairs), 0)


def spans(votes: DataFrame, gap: int = GAP) -> DataFrame:
    """Merged neighbouring diagonals: ``cover`` (share of the template's pairs), ``begin`` and ``end``
    in words of the document, and ``places``, the diagonals with all votes."""
    near = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > gap, F.lit(True))
    numbered = votes.withColumn("new", far.cast("int")).withColumn("span", F.sum("new").over(near))
    full = F.when(F.size("at") == F.col("size"), F.col("diagonal"))
    return numbered.groupBy("doc_id", "text_hash", "template", "label", "exact", "size", "span").agg(
        (F.size(F.array_distinct(F.flatten(F.collect_list("at")))) / F.first("size")).alias("cover"),
        F.min(F.col("diagonal") + F.array_min("at")).alias("begin"),
        F.max(F.col("diagonal") + F.array_max("at") + 2).alias("end"),
        F.collect_list(full).alias("places"),
    )


def verified(found: DataFrame, min_cover: float = MIN_COVER) -> DataFrame:
    """Spans to report: whole places of exact templates, and enough of the others."""
    exact = F.col("exact") & (F.size("places") > 0)
    return found.filter(exact | (~F.col("exact") & (F.col("cover") >= min_cover)))


def scan(
    docs: DataFrame,
    templates: tuple[Template, ...] = PHRASES + NOTICES,
    id_column: str = "doc_id",
    text_column: str = "text",
    gap: int = GAP,
    min_cover: float = MIN_COVER,
    broadcast_pairs: int = BROADCAST_PAIRS,
) -> DataFrame:
    """One row per document: ``doc_id, n_words``, the number of exact ``places``, the ``first`` and
    ``last`` of them (words from 0), ``exact_labels`` and all ``labels`` (sorted arrays), ``score``
    (the best cover of a verified span) and ``spans`` (label, begin, end, cover)."""
    votes = diagonals(docs, templates, id_column, text_column, broadcast_pairs)
    found = verified(spans(votes, gap), min_cover)
    exact = F.when(F.col("exact"), F.col("places"))
    by_doc = found.groupBy("doc_id", "text_hash").agg(
        F.sum(F.size(F.coalesce(exact, F.array().cast("array<int>")))).alias("places"),
        F.min(F.array_min(exact)).cast("bigint").alias("first"),
        F.max(F.array_max(exact)).cast("bigint").alias("last"),
        F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("label")))).alias("exact_labels"),
        F.sort_array(F.collect_set("label")).alias("labels"),
        F.max(F.when(F.col("exact"), 1.0).otherwise(F.col("cover"))).alias("score"),
        F.sort_array(F.collect_list(F.struct("label", "begin", "end", "cover"))).alias("spans"),
    )
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.xxhash64(text_column).alias("text_hash"),
        F.size(words_of(text_column)).cast("bigint").alias("n_words"),
    )
    d, f = rows.alias("d"), by_doc.alias("f")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_hash") == F.col("f.text_hash"))
    none = F.array().cast("array<string>")
    return d.join(f, same, "left").select(
        "d.doc_id",
        "n_words",
        F.coalesce("places", F.lit(0)).cast("bigint").alias("places"),
        "first",
        "last",
        F.coalesce("exact_labels", none).alias("exact_labels"),
        F.coalesce("labels", none).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "spans",
    )
