"""N-gram Jaccard join with a count-vector R-tree.

A document's set is its distinct shingles. Equal sets are one class, and only classes are joined; a
class keeps one row for the join, its documents only their number. Two classes link if the overlap of
their sets is at least ``percent`` of their union. The result is exact: every link between different
sets is found, or both ends are known to be connected by others.

Tokens (shingles) are hashed into ``GROUPS`` groups; the counts of a set by group are a point, and the
summed coordinate minima of two points bound their overlap from above. Boxes around points bound it for
all points inside. One tree over all points prunes nothing at its upper levels, since boxes around
unrelated sets of like size cover each other, and it would be a task for one machine. So points are
dealt into cells first, by a rule that no linked pair escapes: two sets with that overlap share one of
their first tokens in any fixed order, the first ``size - needed + 1``. The order is by how common a
token's hash bucket is, rare ones first, so that passages that many documents share come last. A cell
is the sets with one such token, and an R-tree joins the sets of a cell. A cell of many rows is dealt
into blocks that are joined pairwise, each in a task of its own.

Before the trees, neighbours in a cell (by size, at a few distances) are bounded and verified, and what
they link is contracted. Cells within one component drop out, and the trees only look for pairs across components,
so a group of many near copies is never expanded into all its pairs.

The driver holds counts and one bitmap of fixed size, never links or sets. Tables between steps are
written below ``spark.checkpoint.dir``.

Null and empty texts, and texts without words, have the empty set, and are linked with nothing. Null and
repeated ids are allowed: documents with one text are one class, and a component's id is its smallest
non-null id. Other columns of the input are not looked at. An empty table gives an empty result. Sets and
classes are told apart by 64-bit hashes; tokens are compared by 48 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.components import components
from docloom.llm.shingles import SHINGLE_WORDS, mix, shingle_set
from docloom.llm.tables import stored
from docloom.llm.url_filter import Bloom
from docloom.llm.workers import begin

PERCENT = 80
GROUPS = 128
#: Groups of the finer points by which pairs are bounded once more before sets move.
FINE_GROUPS = 1024
#: Hash buckets in which tokens are counted for their order; a power of two.
SKETCH = 1 << 16
#: Distances in a cell at which neighbours are verified first.
STRIDES = (1, 2, 4, 8)
NODE = 16
#: Tokens of a class before the one of a cell by which pairs of earlier cells are known.
BACK = 3
#: Rows of a cell that one task joins; larger cells are dealt into blocks.
BLOCK = 2048
#: Classes of which a task remembers that it gave their tokens; later ones may give them again.
SEEN = 1 << 20
#: Bits of the map of sets that take part in a verification.
WANTED_BITS = 1 << 22
TOKEN_BITS = np.uint64((1 << 48) - 1)
TOKEN_BYTES = 6


def needed_overlap(total: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with which two sets of ``total`` tokens together link."""
    return -(-percent * total // (100 + percent))


def pack(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view("u1").reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()


def unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // TOKEN_BYTES, 8), "u1")
    wide[:, :TOKEN_BYTES] = np.frombuffer(data, "u1").reshape(-1, TOKEN_BYTES)
    return wide.view("<u8").ravel()


def class_of(tokens: np.ndarray) -> int:
    """A number for a set, from all its tokens; 0 is the empty set's."""
    if not len(tokens):
        return 0
    with np.errstate(over="ignore"):
        h = mix(tokens * np.uint64(0x9E3779B97F4A7C15)).sum(dtype="u8") + np.uint64(len(tokens))
    return int(mix(np.array([h]))[0].astype("i8"))


def token_sets(docs: DataFrame, id_column: str, text_column: str, words: int) -> DataFrame:
    """``doc_id, text_hash, cid, n, tokens``: tokens come once for each class and task, else null."""
    narrow = docs.select(
        F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("text_hash"), F.col(text_column).alias("text")
    )
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("jaccard")
        seen: set[int] = set()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                cids, sizes, sets = [], [], []
                for text in some.column(2).to_pylist():
                    tokens = np.unique(shingle_set(text, words) & TOKEN_BITS)
                    cid = class_of(tokens)
                    cids.append(cid)
                    sizes.append(len(tokens))
                    sets.append(pack(tokens) if len(tokens) and cid not in seen else None)
                    if len(seen) < SEEN:
                        seen.add(cid)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        some.column(1),
                        pa.array(cids, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(sets, pa.binary()),
                    ],
                    ["doc_id", "text_hash", "cid", "n", "tokens"],
                )

    return narrow.mapInArrow(make, f"doc_id {kind}, text_hash bigint, cid bigint, n bigint, tokens binary")


def sketch_of(sets: DataFrame) -> np.ndarray:
    """How many sets have a token in each hash bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("jaccard")
        counts = np.zeros(SKETCH, "i8")
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                tokens = np.concatenate([unpack(x) for x in batch.column(0).slice(k, 500).to_pylist()])
                counts += np.bincount(bucket_of(tokens), minlength=SKETCH)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype("i4")), pa.array(counts[used])], ["bucket", "n"])

    sums = sets.select("tokens").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = sums.toPandas()
    out = np.zeros(SKETCH, "i8")
    out[table.bucket.to_numpy()] = table.n.to_numpy()
    return out


def bucket_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(SKETCH - 1)).astype("i8")


def first_tokens(tokens: np.ndarray, sketch: np.ndarray, percent: int) -> np.ndarray:
    """The tokens of which two linked sets share at least one, rare buckets first."""
    n = len(tokens)
    many = n - -(-percent * n // 100) + 1
    return tokens[np.lexsort((tokens, sketch[bucket_of(tokens)]))[:many]]


def cells(sets: DataFrame, sketch: np.ndarray, percent: int) -> DataFrame:
    """``token, cid, n`` of all rows of cells that have a neighbour of a size that could link, and
    ``near``: classes before this one in the cell, by size, at the distances of ``STRIDES``.

    Rows of a cell are in order of size, so one that fits neither of its neighbours fits no other row.
    """
    shared = sets.sparkSession.sparkContext.broadcast(sketch)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("jaccard")
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                cids, sizes, sets = (c.slice(k, 500) for c in batch.columns)
                firsts = [first_tokens(unpack(x), shared.value, percent) for x in sets.to_pylist()]
                times = [len(x) for x in firsts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(firsts).astype("i8")),
                        pa.array(np.repeat(cids.to_numpy(), times)),
                        pa.array(np.repeat(sizes.to_numpy(), times)),
                    ],
                    ["token", "cid", "n"],
                )

    dealt = sets.select("cid", "n", "tokens").mapInArrow(deal, "token bigint, cid bigint, n bigint")
    by_size = Window.partitionBy("token").orderBy("n", "cid")

    def before(k: int):
        size, cid = F.lag("n", k).over(by_size), F.lag("cid", k).over(by_size)
        return F.when((size * 100 >= F.col("n") * percent) & (cid != F.col("cid")), cid)

    below = F.lag("n", 1).over(by_size) * 100 >= F.col("n") * percent
    above = F.col("n") * 100 >= F.lead("n", 1).over(by_size) * percent
    alone = ~(F.coalesce(below, F.lit(False)) | F.coalesce(above, F.lit(False)))
    near = {f"near{k}": before(k) for k in STRIDES}
    return (
        dealt.withColumns({"alone": alone, **near})
        .filter(~F.col("alone"))
        .select("token", "cid", "n", F.array_compact(F.array(*near)).alias("near"))
    )


def map_of(cids: DataFrame) -> Bloom:
    """A bitmap of fixed size over the classes of ``cids``, by which most other sets can be dropped
    before anything moves."""
    row = Bloom((), WANTED_BITS, 1, 0)
    words = (
        cids.select(row.places(F.col("cid"))[0].alias("place"))
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits"))
        .toPandas()
    )
    full = np.zeros(WANTED_BITS // 64, "i8")
    full[words.word.to_numpy("i8")] = words.bits.to_numpy("i8")
    return Bloom(tuple(full.tolist()), WANTED_BITS, 1, 0)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets link."""
    pairs = stored(pairs, "pairs")
    both = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid")))
    some = sets.filter(map_of(both).contains(F.col("cid"))).groupBy("cid").agg(F.first("tokens").alias("tokens"))
    left = some.select(F.col("cid").alias("a"), F.col("tokens").alias("left"))
    right = some.select(F.col("cid").alias("b"), F.col("tokens").alias("right"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("jaccard")
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, other = unpack(x.as_py()), unpack(y.as_py())
                shared = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(100 * shared >= percent * (len(one) + len(other) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return stored(joined.mapInArrow(compare, "a bigint, b bigint"), "linked")


# --- the R-tree of one cell


def counts_of(tokens: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """A set's point: how many of its tokens fall into each group, a byte each; 255 stands for any
    greater number, too, and bounds nothing."""
    group = (tokens >> np.uint64(24)) % np.uint64(groups)
    return np.bincount(group.astype("i8"), minlength=groups).clip(0, 255).astype("u1")


def as_points(column: pa.ChunkedArray | pa.Array, groups: int = GROUPS) -> np.ndarray:
    points = np.frombuffer(b"".join(column.to_pylist()), "u1").reshape(-1, groups).astype("i4")
    points[points == 255] = 1 << 24
    return points


def points_of(sets: DataFrame, cids: DataFrame, groups: int = GROUPS) -> DataFrame:
    """``cid, n, counts``: the points of the classes of ``cids``, and of few others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("jaccard")
        for batch in batches:
            points = [counts_of(unpack(x), groups).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(points, pa.binary())], ["cid", "n", "counts"]
            )

    some = sets.filter(map_of(cids).contains(F.col("cid"))).select("cid", "n", "tokens")
    points = some.mapInArrow(count, "cid bigint, n bigint, counts binary")
    return stored(points.groupBy("cid").agg(F.first("n").alias("n"), F.first("counts").alias("counts")), "points")


def bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose finer points allow a link."""
    pairs = stored(pairs, "pairs")
    both = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid")))
    points = points_of(sets, both, FINE_GROUPS)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("jaccard")
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                a, b, n_a, n_b, one, other = batch.slice(k, 1024).columns
                least = np.minimum(as_points(one, FINE_GROUPS), as_points(other, FINE_GROUPS))
                sums = least.sum(axis=1, dtype="i8")
                keep = pa.array(sums >= needed_overlap(n_a.to_numpy() + n_b.to_numpy(), percent))
                yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    left, right = (points.select(*[F.col(c).alias(f"{c}_{s}") for c in points.columns]) for s in "ab")
    joined = pairs.join(left, F.col("a") == F.col("cid_a")).join(right, F.col("b") == F.col("cid_b"))
    return joined.select("a", "b", "n_a", "n_b", "counts_a", "counts_b").mapInArrow(compare, "a bigint, b bigint")


def tile_order(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """An order in which near points are neighbours: sliced by size, then by the coordinates that
    differ most."""
    spread = np.argsort(-points.astype("f4").var(axis=0))[:2]
    n_slices = max(1, round((len(points) / NODE) ** 0.5))
    by_size = np.argsort(sizes, kind="stable")
    slices = np.empty(len(points), "i8")
    slices[by_size] = np.arange(len(points)) * n_slices // len(points)
    return np.lexsort((points[:, spread[1]], points[:, spread[0]], slices))


def tree_pairs(
    points: np.ndarray, sizes: np.ndarray, comps: np.ndarray, sides: np.ndarray, across: bool, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of different components that may link; ``across``: of different sides only.

    Boxes are built from the leaves up, each the maxima of up to ``NODE`` below it, and all rows
    descend together, level by level.
    """
    order = tile_order(points, sizes)
    points, sizes, comps, sides = points[order], sizes[order], comps[order], sides[order]
    # of each level: upper corner, least and largest size, the component if it is one, else -1 twice
    levels = [(points, sizes, sizes, comps, comps)]
    while len(levels[-1][0]) > NODE:
        top, least, most, lo, hi = levels[-1]
        at = np.arange(0, len(top), NODE)
        levels.append(
            (
                np.maximum.reduceat(top, at),
                np.minimum.reduceat(least, at),
                np.maximum.reduceat(most, at),
                np.minimum.reduceat(lo, at),
                np.maximum.reduceat(hi, at),
            )
        )
    n_top = len(levels[-1][0])
    query, node = np.repeat(np.arange(len(points)), n_top), np.tile(np.arange(n_top), len(points))
    for depth in range(len(levels) - 1, -1, -1):
        kept_q, kept_n = [], []
        top, least, most, lo, hi = levels[depth]
        for k in range(0, len(query), 1 << 15):
            q, n = query[k : k + (1 << 15)], node[k : k + (1 << 15)]
            # each pair once: the partner is no larger, and could still link by its size
            ok = (least[n] <= sizes[q]) & (most[n] * 100 >= sizes[q] * percent)
            ok &= ~((lo[n] == comps[q]) & (hi[n] == comps[q]))
            q, n = q[ok], n[ok]
            floor = np.maximum(least[n], -(-percent * sizes[q] // 100))
            bound = np.minimum(points[q], top[n]).sum(axis=1, dtype="i8")
            ok = bound >= needed_overlap(sizes[q] + floor, percent)
            kept_q.append(q[ok])
            kept_n.append(n[ok])
        if not kept_q:
            return np.zeros(0, "i8"), np.zeros(0, "i8")
        query, node = np.concatenate(kept_q), np.concatenate(kept_n)
        if depth:
            below = len(levels[depth - 1][0])
            query = np.repeat(query, NODE)
            node = (node[:, None] * NODE + np.arange(NODE)).ravel()
            query, node = query[node < below], node[node < below]
    ok = (sizes[node] < sizes[query]) | (order[node] < order[query])
    if across:
        ok &= sides[node] != sides[query]
    return order[query[ok]], order[node[ok]]


def leaf_pairs(keys: np.ndarray, points: np.ndarray, sizes: np.ndarray, comps: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for many cells of one leaf each, side by side: row by row at every distance."""
    for k in range(1, NODE):
        i = np.flatnonzero((keys[k:] == keys[:-k]) & (comps[k:] != comps[:-k])) if len(keys) > k else np.zeros(0, "i8")
        if not len(i):
            continue
        j = i + k
        small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        ok = small * 100 >= large * percent
        i, j = i[ok], j[ok]
        bound = np.minimum(points[i], points[j]).sum(axis=1, dtype="i8")
        ok = bound >= needed_overlap(sizes[i] + sizes[j], percent)
        yield i[ok], j[ok]


def _join_cells(percent: int):
    """Joins the cells of a partition that is sorted by cell."""

    def finish(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        token, lo, hi, side, cid, n, comp = (table.column(c).to_numpy() for c in ("token", "lo", "hi", "side", "cid", "n", "comp"))
        points = as_points(table.column("counts"))
        new = (token[1:] != token[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        begins = np.concatenate(([0], np.flatnonzero(new) + 1, [len(token)]))
        lengths = np.diff(begins)
        key = np.repeat(np.arange(len(lengths)), lengths)
        back = np.stack([table.column(f"back{k}").to_numpy() for k in range(1, BACK + 1)], axis=1)
        found = []

        def add(i: np.ndarray, j: np.ndarray) -> None:
            known = ((back[i][:, :, None] == back[j][:, None, :]) & (back[i] >= 0)[:, :, None]).any(axis=(1, 2))
            found.append((cid[i[~known]], cid[j[~known]]))

        small = np.repeat((lengths <= NODE) & (lo[begins[:-1]] == hi[begins[:-1]]), lengths)
        rows = np.flatnonzero(small)
        for i, j in leaf_pairs(key[rows], points[rows], n[rows], comp[rows], percent):
            add(rows[i], rows[j])
        for c in np.flatnonzero((lengths > NODE) | (lo[begins[:-1]] != hi[begins[:-1]])):
            at = slice(begins[c], begins[c + 1])
            i, j = tree_pairs(points[at], n[at], comp[at], side[at], lo[begins[c]] != hi[begins[c]], percent)
            add(begins[c] + i, begins[c] + j)
        a = np.concatenate([np.minimum(x, y) for x, y in found] or [np.zeros(0, "i8")])
        b = np.concatenate([np.maximum(x, y) for x, y in found] or [np.zeros(0, "i8")])
        pairs = np.unique(np.stack([a, b]), axis=1) if len(a) else np.zeros((2, 0), "i8")
        pairs = pairs[:, pairs[0] != pairs[1]]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("jaccard")
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([*held, batch])
            key = np.stack([whole.column(c).to_numpy() for c in ("token", "lo", "hi")])
            last = np.flatnonzero((key != key[:, -1:]).any(axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            yield from finish(whole.slice(0, cut))
            held = whole.slice(cut).to_batches()
        if held:
            yield from finish(pa.Table.from_batches(held))

    return join


def cell_pairs(found: DataFrame, sets: DataFrame, roots: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs across components that the trees of all cells let through.

    Two sets may meet in many cells. A row carries its class's ``BACK`` tokens before this one among
    all its cells, and a pair that has one of them in common is left to that token's cell, where the
    same holds; so each pair comes from the cell of its first common token, and few others.
    """
    named = found.select("token", "cid", "n").join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left")
    named = named.select("token", "cid", "n", F.coalesce("root", "cid").alias("comp"))
    cell = Window.partitionBy("token")
    mixed = (
        named.withColumns(
            {
                "one": F.min("comp").over(cell),
                "other": F.max("comp").over(cell),
                "rows": F.count(F.lit(1)).over(cell),
            }
        )
        .filter(F.col("one") != F.col("other"))
        .select("token", "cid", "n", "comp", F.ceil(F.col("rows") / block).cast("int").alias("blocks"))
    )
    by_class = Window.partitionBy("cid").orderBy("token")
    back = {f"back{k}": F.coalesce(F.lag("token", k).over(by_class), F.lit(-1)) for k in range(1, BACK + 1)}
    rows = mixed.withColumns(back)
    points = points_of(sets, found.select("cid"))
    side = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (
        rows.join(points.select("cid", "counts"), "cid")
        .withColumn("side", side)
        .withColumn("other", other)
        .select("token", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "cid", "n", "comp", "counts", *back)
    )
    sorted_cells = dealt.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "n", "cid")
    return sorted_cells.mapInArrow(_join_cells(percent), "a bigint, b bigint").distinct()


def join(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    percent: int = PERCENT,
    shingle_words: int = SHINGLE_WORDS,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: ``doc_id``, ``text_hash``, its class ``cid``, ``n_shingles``, and ``root``,
    the class that names its component; a class without links, and the empty one, is its own."""
    rows = stored(token_sets(docs, id_column, text_column, shingle_words), "token-sets")
    sets = rows.filter(F.col("tokens").isNotNull()).select("cid", "n", "tokens")
    found = stored(cells(sets, sketch_of(sets), percent), "cells")
    near = found.select("cid", F.explode("near").alias("other"))
    first = near.select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")).distinct()
    roots = components(verify(bounded(first, sets, percent), sets, percent))
    more = verify(bounded(cell_pairs(found, sets, roots, percent, block), sets, percent), sets, percent)
    # contracted links: components of components
    contracted = (
        more.join(roots.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a", "left")
        .join(roots.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b", "left")
        .select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    )
    tops = components(contracted).select(F.col("node").alias("root"), F.col("root").alias("top"))
    nodes = roots.unionByName(tops.select(F.col("root").alias("node"), "root")).distinct()
    final = nodes.join(tops, "root", "left").groupBy("node").agg(F.min(F.coalesce("top", "root")).alias("root"))
    return (
        rows.select("doc_id", "text_hash", "cid", F.col("n").alias("n_shingles"))
        .join(final.select(F.col("node").alias("cid"), "root"), "cid", "left")
        .select("doc_id", "text_hash", "cid", "n_shingles", F.coalesce("root", "cid").alias("root"))
    )


def with_component(joined: DataFrame) -> DataFrame:
    """Adds ``component_id``, the smallest id of a component; an empty document's is its own."""
    least = joined.filter(F.col("n_shingles") > 0).groupBy("root").agg(F.min("doc_id").alias("least"))
    return joined.join(least, "root", "left").withColumn(
        "component_id", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    )


def one_per_component(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT
) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id (a null id comes last).

    Each empty document is a component of its own; of rows equal in id and text one stays.
    """
    joined = stored(join(docs, id_column, text_column, percent), "components")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    firsts = joined.filter(F.col("n_shingles") > 0).groupBy("root").agg(F.min(place).alias("first")).select("first.*")
    empty = joined.filter(F.col("n_shingles") == 0).select(F.lit(False).alias("unnamed"), "doc_id", "text_hash")
    keep = firsts.unionAll(empty).select(F.col("doc_id").alias("_keep_id"), F.col("text_hash").alias("_keep_hash")).distinct()
    keyed = docs.withColumn("_text_hash", F.xxhash64(text_column))
    same = keyed[id_column].eqNullSafe(keep["_keep_id"]) & (keyed["_text_hash"] == keep["_keep_hash"])
    return keyed.join(keep, same, "left_semi").dropDuplicates([id_column, "_text_hash"]).drop("_text_hash")
