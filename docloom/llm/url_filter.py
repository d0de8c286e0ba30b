"""URL rules by a cascade of Bloom filters, in DataFrame functions only.

A rule is a host and a path. It fits its host and all subdomains where the URL's path starts with the
rule's; of the rules that fit, the longest (then the one with the longer host) wins. The keys that a
URL could match are its host's suffixes joined with the beginnings of its path, and only as many as
the list's own shapes allow. Level 1 of a cascade encodes the listed keys; level 2 encodes those
unlisted keys of the whole corpus that level 1 takes for listed; level 3 the listed ones that level 2
takes for unlisted; and so on until a level errs on nothing. For every key of the corpus and of the
list the answer is then exact, and URLs are judged in a narrow pass without a join.

The first level has about log2(keys of the corpus / listed keys) hashes, the others one, so size
follows the list and not the corpus. A list whose filter would exceed ``max_filter_bytes`` is joined
on its keys instead.

A null URL, or one without ``://``, has an empty host and path; it can only match a rule that is
itself empty. Null hosts or paths of rules count as empty, rules with another verdict than allow or
block are an error, and of two rules with the same key block wins. Repeated URLs and null page ids
are judged row by row. Extra columns of the pages stay out of the way: only the named ones are read.
An empty list leaves every URL to ``default``; an empty table of pages gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.tables import ascii_lower, stored

MAX_FILTER_BYTES = 1 << 20
MAX_LEVELS = 64


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; then
    what follows up to ``?``, ``#`` or the end."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Shapes:
    """How keys of a list can look: the most host labels, and the lengths of paths."""

    labels: int
    path_lengths: tuple[int, ...]

    @classmethod
    def of(cls, rules: DataFrame) -> Shapes:
        row = rules.agg(
            F.max(F.size(F.split("host", "\\."))).alias("labels"),
            F.sort_array(F.collect_set(F.length("path"))).alias("lengths"),
        ).first()
        return cls(row.labels or 0, tuple(row.lengths or ()))


def candidates(host: Column, path: Column, shapes: Shapes) -> Column:
    """Keys that rules of these shapes could have for a URL, with what ranks them."""
    labels = F.split(host, "\\.")
    most = F.least(F.size(labels), F.lit(shapes.labels))
    counts = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    suffixes = F.transform(counts, lambda n: F.array_join(F.slice(labels, -n, n), "."))

    def with_paths(suffix: Column) -> Column:
        return F.array(
            *[
                F.when(
                    F.length(path) >= n,
                    F.struct(
                        (F.length(suffix) + n).alias("length"),
                        F.length(suffix).alias("host_length"),
                        F.concat(suffix, F.substring(path, 1, n)).alias("key"),
                    ),
                )
                for n in shapes.path_lengths
            ]
        )

    if not shapes.path_lengths:
        return F.array().cast("array<struct<length:int,host_length:int,key:string>>")
    return F.filter(F.flatten(F.transform(suffixes, with_paths)), lambda x: x.isNotNull())


@dataclass(frozen=True)
class Bloom:
    words: tuple[int, ...]
    bits: int
    hashes: int
    seed: int

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(i)), F.lit(self.bits)) for i in range(self.hashes)]

    def contains(self, key: Column) -> Column:
        # folded to one literal array when the query is planned
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")

        def is_set(place: Column) -> Column:
            word = F.get(words, F.shiftright(place, 6).cast("int"))
            return F.getbit(word, (place % 64).cast("int")) == 1

        found = F.lit(True)
        for place in self.places(key):
            found = found & is_set(place)
        return found


def bloom_bits(n: int, rate: float) -> int:
    return max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64) * 64)


def build_bloom(keys: DataFrame, n: int, rate: float, seed: int) -> Bloom:
    """A filter of the ``n`` rows of ``keys``; what reaches the driver is the filter itself."""
    empty = Bloom((), bloom_bits(n, rate), max(1, round(-math.log2(rate))), seed)
    words = (
        keys.select(F.explode(F.array(*empty.places(F.col("key")))).alias("place"))
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits"))
        .collect()
    )
    full = [0] * (empty.bits // 64)
    for row in words:
        full[row.word] = row.bits
    return Bloom(tuple(full), empty.bits, empty.hashes, seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Bloom, ...]

    def contains(self, key: Column) -> Column:
        """Exact for the keys of the list and of the universe: listed unless the first level that
        lacks the key is an odd one."""
        found = F.lit(False)
        for level in reversed(self.levels):
            found = level.contains(key) & ~found
        return found


def first_rate(n_listed: int, n_universe: int) -> float:
    """False positives of level 1, so that it errs on fewer keys than are listed."""
    return min(0.5, n_listed / (math.sqrt(2) * max(1, n_universe)))


def build_cascade(listed: DataFrame, universe: DataFrame, n_listed: int, n_universe: int) -> Cascade:
    """``listed(key)`` distinct, ``universe(key)`` all distinct keys that will be asked for."""
    if n_listed == 0:
        return Cascade(())
    inside, outside, n = listed, universe.join(listed, "key", "left_anti"), n_listed
    rate, levels = first_rate(n_listed, n_universe), []
    while n:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the cascade does not end")
        levels.append(build_bloom(inside, n, rate, len(levels)))
        wrong = stored(outside.filter(levels[-1].contains(F.col("key"))), "cascade")
        inside, outside, n, rate = wrong, inside, wrong.count(), 0.5
    return Cascade(tuple(levels))


def judge(
    pages: DataFrame,
    rules: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    default: str = "allow",
    max_filter_bytes: int = MAX_FILTER_BYTES,
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page; ``rules(host, path, verdict)``.

    ``rule`` is the winning rule's host and path in one string, else null.
    """
    bad = rules.filter(~F.coalesce(F.col("verdict").isin("allow", "block"), F.lit(False)))
    if bad.limit(1).count():
        raise ValueError("a rule's verdict is allow or block")
    rules = stored(
        rules.select(
            ascii_lower(F.coalesce("host", F.lit(""))).alias("host"),
            F.coalesce("path", F.lit("")).alias("path"),
            "verdict",
        )
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # block comes after allow
        .withColumn("key", F.concat("host", "path")),
        "rules",
    )
    shapes = Shapes.of(rules)
    host, path = host_and_path(url_column)
    urls = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    keys = candidates(F.col("host"), F.col("path"), shapes)
    sizes = {r.verdict: r["count"] for r in rules.groupBy("verdict").count().collect()}
    exploded = urls.select(F.explode(keys.key).alias("key"))
    universe = stored(exploded.distinct(), "urls")
    n_universe = universe.count()
    largest = max((bloom_bits(n, first_rate(n, n_universe)) / 8 for n in sizes.values()), default=0)
    if largest > max_filter_bytes:
        return judge_by_join(urls, keys, rules, default)
    cascades = {
        v: build_cascade(rules.filter(F.col("verdict") == v).select("key"), universe, sizes.get(v, 0), n_universe)
        for v in ("allow", "block")
    }
    listed = F.filter(keys, lambda x: cascades["block"].contains(x.key) | cascades["allow"].contains(x.key))
    found = urls.withColumn("rule", F.array_max(listed).key)
    verdict = (
        F.when(F.col("rule").isNull(), default)
        .when(cascades["block"].contains(F.col("rule")), "block")
        .otherwise("allow")
    )
    return found.withColumn("verdict", verdict)


def judge_by_join(urls: DataFrame, keys: Column, rules: DataFrame, default: str) -> DataFrame:
    """The same for a list too long for filters: keys of distinct URLs are joined to the rules."""
    distinct = urls.select("host", "path").distinct()
    found = (
        distinct.withColumn("candidate", F.explode(keys))
        .join(rules.select(F.col("key").alias("listed"), "verdict"), F.col("candidate.key") == F.col("listed"))
        .groupBy("host", "path")
        .agg(F.max(F.struct("candidate", "verdict")).alias("best"))
        .select("host", "path", F.col("best.candidate.key").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    return urls.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
