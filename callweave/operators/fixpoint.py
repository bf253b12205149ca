"""Fixpoints over edge tables: reachability, least distances and transitive closure.

Each level joins the frontier to the edges and removes what was seen; every few
levels the lineage is cut by a table written to the shared folder.  Only an emptiness
test reaches the driver.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Levels of any unbounded walk at most: a guard, not a limit of the semantics.
MOST_LEVELS = 10_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    A local session that has none gets a temporary one; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the session ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that is no longer read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows as a Parquet table in the shared folder."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


#: Bytes of what a plan reads for which it gets one partition, and a size that stands for an unknown one.
PART, UNKNOWN = 16 << 20, 1 << 50


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by keys over as many partitions as the size of what they read asks for, so that no task grows with the input; small ones as they are."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    n = -(-sum(x for x in sizes if x < UNKNOWN) // PART)
    return rows.repartition(min(n, 10_000), *keys) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


#: Levels that one written table covers while the frontier has so few rows.
AT_ONCE, FEW = 4, 2_000


def min_dist(starts: DataFrame, edges: DataFrame, max_depth: int | None = None, key: str | None = None) -> DataFrame:
    """(node, dist), or (key, node, dist): least number of edges from any start.

    ``starts``: (node) or (key, node).  ``edges``: (src, dst).  Starts have distance 0.
    A large frontier goes one level at a time; a small one several, since the levels'
    jobs then cost more than walking over a seen node again.
    """
    keys = [key] if key else []
    # Dealt out by where a step begins, and kept so: a level moves its frontier, not the edges.
    edges = spread(edges.select("src", "dst"), "src").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    seen = cut(starts.select(*keys, "node").distinct().withColumn("dist", F.lit(0)))
    tables, frontier, level, few = 1, seen, 0, True
    while max_depth is None or level < max_depth:
        steps, at, walked = 1 if not few else AT_ONCE if max_depth is None else min(AT_ONCE, max_depth - level), frontier.select(*keys, "node"), None
        for step in range(1, steps + 1):
            at = at.join(edges, F.col("node") == F.col("src")).select(*keys, F.col("dst").alias("node")).distinct()
            reached = at.withColumn("dist", F.lit(level + step))
            walked = reached if walked is None else walked.unionByName(reached)
        least = walked.groupBy(*keys, "node").agg(F.min("dist").alias("dist")) if steps > 1 else walked
        new = cut(least.join(seen.select(*keys, "node"), [*keys, "node"], "left_anti"))
        level += steps
        frontier = new.where(F.col("dist") == level)
        if level >= MOST_LEVELS:
            raise RuntimeError(f"no fixpoint after {MOST_LEVELS} levels")
        tables += 1
        seen = seen.unionByName(new)
        if tables % 8 == 0:
            seen = cut(seen)
        if not (n := frontier.count()):
            break
        few = n <= FEW
    edges.unpersist()
    return seen


def closure(pairs: DataFrame, src: str, dst: str) -> DataFrame:
    """All (src, dst) with ``dst`` reachable from ``src``; cycles are safe, a start is not its own result.

    Path doubling: round k knows every pair at a distance up to 2**k, and only the
    pairs that were new in the last round are joined to all, on their left.  So a chain
    of length n takes log2(n) rounds, and no pair of old ones meets again.
    """
    known = cut(pairs.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b").distinct())
    fresh = known
    while True:
        right = known.select(F.col("a").alias("m"), F.col("b").alias("c"))
        wider = fresh.join(right, F.col("b") == F.col("m")).select("a", F.col("c").alias("b")).where("a <> b")
        fresh = cut(wider.join(known, ["a", "b"], "left_anti").distinct())
        if fresh.isEmpty():
            return known.select(F.col("a").alias(src), F.col("b").alias(dst))
        known = known.unionByName(fresh)  # a flat union of written tables
