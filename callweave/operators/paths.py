"""Bounded path search between functions.

Paths grow backwards from the target, one edge a level, inside the corridor of
nodes that lie on some walk of at most ``max_depth`` edges from a start to the
target.  The levels are in order of length, so the search ends with the level that
completes ``max_paths`` paths.  The result is in order of length, then nodes, then
call sites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators.edges import hubs
from callweave.operators.fixpoint import cut, min_dist

#: Partial paths in one level beyond which the search is refused.
MOST_PARTIAL = 20_000_000


def corridor(starts: DataFrame, target: str, edges: DataFrame, max_depth: int, cut_off: DataFrame | None = None) -> DataFrame:
    """Edges on a walk of at most ``max_depth`` edges from a start (node) to the target, with the caller's ``from_start``.

    ``cut_off`` (node): functions whose callers are not followed, but for the target.
    """
    spark = edges.sparkSession
    if cut_off is not None:
        blocked = cut_off.where(F.col("node") != target).select(F.col("node").alias("callee"))
        edges = edges.join(blocked, "callee", "left_anti")
    pairs = edges.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    back = min_dist(spark.createDataFrame([(target,)], ["node"]), pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), max_depth)
    near = back.select(F.col("node").alias("callee"), F.col("dist").alias("to_target"))
    # Forward only over what reaches the target.
    kept = cut(edges.join(near, "callee").distinct())  # registrations may repeat
    ahead = min_dist(starts, kept.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), max_depth)
    far = ahead.select(F.col("node").alias("caller"), F.col("dist").alias("from_start"))
    return kept.join(far, "caller").where(F.col("from_start") + 1 + F.col("to_target") <= max_depth).drop("to_target")


def find_paths(
    starts: DataFrame,
    target: str,
    edges: DataFrame,
    max_depth: int = 20,
    max_paths: int = 10,
    max_fan_in: int = 0,
    stored: DataFrame | None = None,
    edge_simple: bool = False,
) -> DataFrame:
    """(rank, length, nodes, hops) of the first ``max_paths`` simple paths from any start (node) to ``target``.

    A path ends at the first start that is met going backwards; a target that is a
    start gives one path without hops.  ``hops`` are structs of the edges' columns, in
    order from the start.  ``edge_simple``: nodes may repeat, edges may not.  Functions
    with more than ``max_fan_in`` callers in ``stored`` are not entered from behind (0:
    no limit).  A partial path that can no longer reach a start in time is dropped.  A
    level with over ``MOST_PARTIAL`` partial paths is a ``ValueError``.
    """
    blocked = cut(hubs(stored if stored is not None else edges, max_fan_in).select(F.col("callee").alias("node"))) if max_fan_in else None
    starts = cut(starts.select("node").distinct())
    inside = cut(corridor(starts, target, edges, max_depth, blocked))
    hop = F.struct(*edges.columns)
    step = inside.select(F.col("callee").alias("_to"), F.col("caller").alias("_from"), hop.alias("_hop"), F.col("from_start").alias("_left"))
    head = edges.sparkSession.createDataFrame([(target,)], "head string")
    partial = head.select("head", F.array("head").alias("nodes"), F.array().cast(f"array<{inside.select(hop.alias('h')).dtypes[0][1]}>").alias("hops"))
    is_start = starts.select(F.col("node").alias("head"), F.lit(True).alias("_start"))

    def level(rows: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
        """Paths that begin at a start, the others, and their numbers: one table and one count a level."""
        rows = cut(rows.join(is_start, "head", "left"))
        n = rows.agg(F.count("*").alias("n"), F.count("_start").alias("done")).first()
        return rows.where("_start").drop("_start"), rows.where("_start is null").drop("_start"), n.done, n.n - n.done

    done, partial, found, left = level(partial)
    length = 0
    while length < max_depth and left and found < max_paths:
        length += 1
        grown = partial.join(step, (F.col("head") == F.col("_to")) & (F.col("_left") <= max_depth - length))
        grown = grown.where(~F.array_contains("hops", F.col("_hop")) if edge_simple else ~F.array_contains("nodes", F.col("_from")))
        grown = grown.select(
            F.col("_from").alias("head"), F.concat(F.array("_from"), "nodes").alias("nodes"), F.concat(F.array("_hop"), "hops").alias("hops")
        )
        ended, partial, more, left = level(grown)
        if left > MOST_PARTIAL:
            raise ValueError(f"over {MOST_PARTIAL} partial paths of {length} edges; narrow the filter or the depth")
        done, found = done.unionByName(ended), found + more
    ordered = done.orderBy(F.size("hops"), "nodes", F.transform("hops", lambda h: h["call_site"])).limit(max_paths)
    # At most max_paths rows are ranked.
    ranked = ordered.agg(F.array_sort(F.collect_list(F.struct(F.size("hops").alias("length"), "nodes", "hops"))).alias("p"))
    ranked = ranked.select(F.posexplode("p").alias("rank", "x"))
    return ranked.select((F.col("rank") + 1).alias("rank"), "x.length", "x.nodes", "x.hops")


def named(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``names``: the display names of ``nodes``, or the usr of functions without one."""
    flat = paths.select("rank", F.posexplode("nodes").alias("pos", "usr"))
    flat = flat.join(nodes.select("usr", "qualified_name"), "usr", "left").select("rank", F.struct("pos", F.coalesce("qualified_name", "usr").alias("name")).alias("x"))
    lists = flat.groupBy("rank").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["name"]).alias("names"))
    return paths.join(lists, "rank")


def skipped_hubs(starts: DataFrame, target: str, edges: DataFrame, stored: DataFrame, max_depth: int, max_fan_in: int) -> DataFrame:
    """(node) that lie within reach of the target and were not entered for their callers."""
    blocked = hubs(stored, max_fan_in).select(F.col("callee").alias("node")).where(F.col("node") != target)
    open_edges = edges.join(blocked.withColumnRenamed("node", "callee"), "callee", "left_anti")
    back = open_edges.select(F.col("callee").alias("src"), F.col("caller").alias("dst"))
    reached = min_dist(edges.sparkSession.createDataFrame([(target,)], ["node"]), back, max_depth)
    return reached.join(blocked, "node", "left_semi").select("node")
