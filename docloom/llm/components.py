"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.tables import stored

MAX_ROUNDS = 60


def _hang(edges: DataFrame, every: bool) -> DataFrame:
    """Links between each node's neighbours and the least of them and itself.

    ``every``: each node takes part with all neighbours, and larger ones are hung on the least;
    else only with its smaller neighbours, and it is hung itself, too. The least neighbour is an
    aggregate and meets the links in a join, so that no task holds the neighbours of one node.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if every else edges
    # here a is the node whose neighbours are looked at
    least = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("root"))
    near = both.join(least, "a")
    if every:
        hung = near.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("root").alias("b"))
    else:
        hung = near.select(F.col("b").alias("a"), F.col("root").alias("b")).unionByName(
            least.select("a", F.col("root").alias("b"))
        )
    return hung.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root``: for each node of ``links(a, b)`` the least node of its component.

    Large-star and small-star steps in turn, until every node hangs on a root of its own component.
    Each round is written, so a lost executor costs one round.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b"))
    edges = stored(edges.distinct(), "links")
    for _ in range(MAX_ROUNDS):
        edges = stored(_hang(_hang(edges, True), False), "links")
        # settled: a node hangs once at most, and what hangs carries nothing
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        loose = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if loose.filter("up > 1 or (up = 1 and down = 1)").limit(1).count() == 0:
            roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
    raise RuntimeError("components do not settle")
