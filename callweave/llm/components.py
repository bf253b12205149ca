"""Connected components over a table of links, by alternating star contractions.

Each round points every node's larger neighbours at its least neighbour (large star),
then its smaller ones (small star); the links shrink to stars around the least node
of each component in a number of rounds that grows with the logarithm of its size.
Links stay distributed: a round is two aggregates and two joins, each star ended by a
written table, and the driver sees a few numbers a round.  Links of nodes with very
many are not dealt out by their node: their least neighbours, a bounded table, are sent
to where the links are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import cut

#: A node with more links than this, and than one in so many of all links, is a hub; so there are at most 2 * HUBS hubs.
HUB, HUBS = 500, 100_000


def _least(sides: DataFrame) -> DataFrame:
    """(n, m): the least of each node ``a`` and its neighbours."""
    return sides.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("m", "a").alias("m"))


def _star(links: DataFrame, large: bool) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sides = both if large else both.where("a > b")
    limit = max(HUB, links.count() // HUBS)
    hubs = cut(sides.groupBy("a").agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select("a"))
    if hubs.isEmpty():
        least = _least(sides)
        moved = sides.join(least, F.col("a") == F.col("n"))
    else:
        few = sides.join(F.broadcast(hubs), "a", "left_anti")
        many = sides.join(F.broadcast(hubs), "a", "left_semi")
        small, great = _least(few), cut(_least(many))
        least = small.unionByName(great)
        moved = few.join(small, F.col("a") == F.col("n")).unionByName(many.join(F.broadcast(great), F.col("a") == F.col("n")))
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        own = least.select(F.col("n").alias("a"), F.col("m").alias("b"))
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(own)
    return cut(out.where("a <> b").distinct())


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("s")).first()
    return row.n, row.s


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long): the component is its least node.

    Repeated links, loops and either direction are allowed; a node with only a loop
    is not returned, and an empty table gives an empty result.
    """
    links = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(links)
    while state[0]:
        links = _star(_star(links, large=True), large=False)
        if (now := _state(links)) == state:
            break
        state = now
    members = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(members.select("component", "component").distinct())
