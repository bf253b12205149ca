"""Exact top-k search by inner product with three-phase uniform thresholds.

Vectors are integers, cut into ``NODES`` ranges of components.  Each range is a node: it
has its own part of every vector and knows partial scores only; a score is the sum over
the nodes.

1. Every node keeps, for each query and block of candidates, a list of its ``KEPT`` best
   partial scores in order.  The whole scores of what all nodes list, and of each node's
   very best, are known or computed; the k-th best of these is at most the final k-th
   best score: a safe cutoff c.
2. An entry whose partial scores are all below c / NODES cannot reach c, so each node is
   told c / NODES and sends its entries at or above it.  Lists that reach down to it are
   cut there; only blocks whose list ends above it are scanned again.
3. What was collected is summed, and the k-th best of the whole sums may raise c.  An
   entry that cannot reach c, with less than the part asked for wherever no node sent
   one, goes.  Of the others the missing parts alone are computed.

Equal vectors are one class from the start, with the few least ids that can appear in a
result, so a vector that a third of all rows have is scored once.  Queries and candidates
meet in blocks of bounded size, dealt over ``SALTS`` tasks for each block of queries.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.common import arrow_map, cut

NODES = 2
#: Vectors in a block of queries or candidates at most, and entries of a node's list for each query and block.
BLOCK, KEPT = 2048, 16
#: Copies of a query block that candidates are dealt to at most.
SALTS = 64
_EXACT = 2.0**53
_PACKED = "block long, node int, ids array<long>, part binary"
_LISTS = "qid long, node int, block long, ids array<long>, scores array<long>, last long"


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, x: array<long>) with floor(scale * component); vectors that are null or hold null or non-finite components are left out."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))
    return vectors.where(x.isNotNull() & ~bad & F.col(key).isNotNull()).select(F.col(key).alias("vec_id"), whole.alias("x"))


def _columns(dims: int) -> list[tuple[int, int]]:
    """First component and number of components of every node."""
    edges = [dims * j // NODES for j in range(NODES + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _packed(rows: DataFrame, dims: int) -> DataFrame:
    """Rows (id, x) in blocks: for each block and node the ids and the node's matrix, zeros for missing components."""
    # The rank within a hash bucket bounds a block whatever ids there are.
    buckets = max(1, -(-2 * rows.count() // BLOCK))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("id"))
    rows = rows.withColumn("_part", F.floor((rank - 1) / BLOCK))
    lists = rows.groupBy("_bucket", "_part").agg(F.collect_list(F.struct("id", "x")).alias("rows"))
    lists = lists.select((F.col("_part") * buckets + F.col("_bucket")).alias("block"), F.col("rows.id").alias("ids"), F.col("rows.x").alias("xs"))
    columns = _columns(dims)

    def pack(batch: dict) -> dict:
        out: dict[str, list] = {"block": [], "node": [], "ids": [], "part": []}
        for block, ids, xs in zip(batch["block"], batch["ids"], batch["xs"], strict=True):
            whole = np.zeros((len(xs), dims), np.int64)
            for i, x in enumerate(xs):
                whole[i, : len(x)] = x
            for node, (a, n) in enumerate(columns):
                for c, v in zip(out, (block, node, ids, _bytes(whole[:, a : a + n])), strict=True):
                    out[c].append(v)
        return out

    return cut(arrow_map(lists, pack, _PACKED, step=4))


def _bytes(part: np.ndarray) -> bytes:
    """The width of a number in one byte, then the numbers at the least width that holds them."""
    most = int(np.abs(part).max(initial=0))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([width]) + part.astype(f"<i{width}").tobytes()


def _matrix(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers; in floating point where that is exact."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    bound = float(np.abs(q.astype(np.float64)).max()) * float(np.abs(c.astype(np.float64)).max()) * q.shape[1]
    if bound < _EXACT:
        return np.rint(q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return q.astype(np.int64) @ c.T.astype(np.int64)


def _best(scores: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the ``kept`` best of every row, the best first."""
    if scores.shape[1] > kept:
        at = np.argpartition(scores, scores.shape[1] - kept, axis=1)[:, -kept:]
    else:
        at = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    values = np.take_along_axis(scores, at, axis=1)
    order = np.argsort(-values, axis=1, kind="stable")
    return np.take_along_axis(at, order, axis=1), np.take_along_axis(values, order, axis=1)


def _local_lists(batch: dict, kept: int) -> dict:
    """Phase 1 at one node: for each query of a block the best entries of a block of candidates."""
    out: dict[str, list] = {c: [] for c in ("qid", "node", "block", "ids", "scores", "last")}
    for node, block, ids, part, qids, queries in zip(*(batch[c] for c in ("node", "block", "ids", "part", "qids", "queries")), strict=True):
        scores = _product(_matrix(queries, len(qids)), _matrix(part, len(ids)))
        at, values = _best(scores, kept)
        out["qid"] += qids
        out["node"] += [node] * len(qids)
        out["block"] += [block] * len(qids)
        out["ids"] += np.array(ids)[at].tolist()
        out["scores"] += values.tolist()
        out["last"] += values[:, -1].tolist() if len(ids) > kept else [None] * len(qids)
    return out


def _at_or_above(batch: dict) -> dict:
    """Phase 2 at one node: all entries of a block at or above the part of the cutoff, for the queries that ask."""
    out: dict[str, list] = {c: [] for c in ("qid", "id", "node", "score")}
    for node, ids, part, qids, queries, wanted in zip(*(batch[c] for c in ("node", "ids", "part", "qids", "queries", "wanted")), strict=True):
        asked = {w["qid"]: w["part"] for w in wanted}
        place = [i for i, q in enumerate(qids) if q in asked]
        scores = _product(_matrix(queries, len(qids))[place], _matrix(part, len(ids)))
        for i, row in zip(place, scores, strict=True):
            least = asked[qids[i]]
            at = np.flatnonzero(row >= least) if least is not None else np.arange(len(row))
            out["qid"] += [qids[i]] * len(at)
            out["id"] += np.array(ids)[at].tolist()
            out["node"] += [node] * len(at)
            out["score"] += row[at].tolist()
    return out


def _dot(a: Column, b: Column) -> Column:
    """Inner product over the components that both have."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0).cast("long"), lambda total, x: total + x)


def _scored(pairs: DataFrame, queries: DataFrame, classes: DataFrame, dims: int, known: str | None = None) -> DataFrame:
    """Adds ``rest`` to pairs (qid, id): the parts of the score that ``known`` (the nodes that sent theirs) lacks, or all."""
    both = pairs.join(classes.select("id", "x"), "id").join(queries.select("qid", F.col("x").alias("y")), "qid")
    rest = F.lit(0).cast("long")
    for node, (a, n) in enumerate(_columns(dims)):
        part = _dot(F.slice("x", a + 1, n), F.slice("y", a + 1, n)) if n else F.lit(0).cast("long")
        rest = rest + (F.when(F.array_contains(known, node), 0).otherwise(part) if known else part)
    return both.withColumn("rest", rest).drop("x", "y")


class Search:
    """The three phases for one set of vectors and queries; every step is a table.

    ``lists``: what the nodes keep in phase 1; ``cutoffs`` (qid, cutoff, part); ``short``:
    lists that end above the cutoff's part; ``entries``: what the nodes send in phase 2;
    ``open``: pairs that phase 3 has to resolve; ``scores`` (qid, id, score).
    """

    def __init__(self, vectors: DataFrame, queries: DataFrame, k: int):
        first = queries.groupBy("vec_id").agg(F.min("x").alias("x"))
        # A query's own rows may come before its k candidates.
        own = vectors.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").groupBy("vec_id").count().agg(F.max("count")).first()[0]
        self.most = most = k + (own or 0)
        dims = vectors.agg(F.max(F.size("x"))).first()[0] or 0
        place = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))
        kept = vectors.withColumn("_place", place).where(F.col("_place") <= most)
        classes = kept.groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("vec_ids"))
        self.classes = classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
        self.queries = asked = cut(first.select("x").distinct().withColumn("qid", F.monotonically_increasing_id()))
        self.members = first.join(asked, "x").select("qid", F.col("vec_id").alias("query_id"))

        parts = _packed(classes.select("id", "x"), dims)
        blocks = _packed(asked.select(F.col("qid").alias("id"), "x"), dims)
        blocks = blocks.select(F.col("block").alias("q"), "node", F.col("ids").alias("qids"), F.col("part").alias("queries"))
        n_parts, n_blocks = (t.agg(F.max(c)).first()[0] for t, c in ((parts, "block"), (blocks, "q")))
        salts = min(SALTS, (n_parts or 0) + 1)
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n or 0).cast("long")))
        salt = F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt")
        spread = parts.select("*", every(n_blocks).alias("q"), salt)
        copies = blocks.select("*", every(salts - 1).alias("salt"))
        meet = spread.join(copies, ["q", "node", "salt"])

        kept = max(KEPT, most)
        columns = ["node", "block", "ids", "part", "qids", "queries"]
        self.lists = lists = cut(arrow_map(meet.select(*columns), lambda batch: _local_lists(batch, kept), _LISTS, step=1))

        listed = lists.select("qid", "node", F.explode(F.arrays_zip("ids", "scores")).alias("e")).select("qid", "node", F.col("e.ids").alias("id"), F.col("e.scores").alias("score"))
        # Pairs that are on every node's lists have their whole score; of the others the best of each node are scored.
        both = listed.groupBy("qid", "id").agg(F.sum("score").alias("score"), F.count("*").alias("n")).where(F.col("n") == NODES).select("qid", "score", "id")
        best = Window.partitionBy("qid", "node").orderBy(F.desc("score"), "id")
        heads = listed.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= most).select("qid", "id").distinct()
        heads = _scored(heads, asked, classes, dims).select("qid", F.col("rest").alias("score"), "id")
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
        kth = lambda rows: rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") == most).select("qid", "score")
        safe = kth(both).unionByName(kth(heads)).groupBy("qid").agg(F.max("score").alias("cutoff"))
        self.cutoffs = cut(safe.select("qid", "cutoff", F.ceil(F.col("cutoff") / F.lit(NODES).cast("decimal(1,0)")).cast("long").alias("part")))

        told = lists.join(self.cutoffs, "qid", "left")
        reaches = F.col("last").isNull() | (F.col("part") > F.col("last"))
        told = told.withColumn("reaches", F.coalesce(reaches, F.lit(False)))
        sent = told.where("reaches").select("qid", "node", "part", F.explode(F.arrays_zip("ids", "scores")).alias("e"))
        sent = sent.where(F.col("part").isNull() | (F.col("e.scores") >= F.col("part"))).select("qid", F.col("e.ids").alias("id"), "node", F.col("e.scores").alias("score"))
        # Lists that end too early: at most a block of queries for each block of candidates.
        self.short = short = cut(told.where("not reaches").select("qid", "node", "block", "part"))
        in_block = blocks.select("q", F.explode("qids").alias("qid")).distinct()
        wanted = short.join(in_block, "qid").groupBy("q", "node", "block").agg(F.collect_list(F.struct("qid", "part")).alias("wanted"))
        again = parts.withColumnRenamed("part", "_part").join(wanted, ["node", "block"]).withColumnRenamed("_part", "part").join(blocks, ["q", "node"])
        more = arrow_map(again.select("node", "ids", "part", "qids", "queries", "wanted"), _at_or_above, "qid long, id long, node int, score long", step=1)
        self.entries = cut(sent.unionByName(more))

        summed = self.entries.groupBy("qid", "id").agg(F.sum("score").alias("known"), F.collect_set("node").alias("nodes"))
        summed = cut(summed.withColumn("missing", NODES - F.size("nodes")))
        # Entries that every node sent may raise the cutoff.
        order = Window.partitionBy("qid").orderBy(F.desc("known"), "id")
        raised = summed.where("missing = 0").withColumn("_place", F.row_number().over(order)).where(F.col("_place") == most)
        raised = self.cutoffs.join(raised.select("qid", F.col("known").alias("raised")), "qid", "left")
        raised = cut(raised.select("qid", "part", F.greatest("cutoff", "raised").alias("least")))
        could = F.col("least").isNull() | (F.col("known") + F.col("missing") * (F.col("part") - 1) >= F.col("least"))
        summed = cut(summed.join(raised, "qid", "left").where(could))
        done = summed.where("missing = 0").select("qid", "id", F.col("known").alias("score"), "least")
        self.open = summed.where("missing > 0")
        resolved = _scored(self.open, asked, classes, dims, "nodes").select("qid", "id", (F.col("known") + F.col("rest")).alias("score"), "least")
        scores = done.unionByName(resolved)
        self.scores = scores.where(F.col("least").isNull() | (F.col("score") >= F.col("least"))).select("qid", "id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best candidates of every query, ties to the smaller vec_id.

    Both tables are (vec_id, x: array<long>), as :func:`quantised` makes them.  Rows
    with the query's vec_id are no candidates for it.  Vectors of different lengths
    are compared over the components that both have.  Repeated rows are candidates
    each; a repeated query counts once, with its least vector.  Scores must fit 64 bits.
    An empty table on either side gives an empty result.
    """
    found = Search(vectors, queries, k)
    entries = found.scores.join(found.classes.select("id", F.explode("vec_ids").alias("vec_id")), "id").select("qid", "vec_id", "score")
    place = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "vec_id"))
    best = entries.withColumn("_place", place("qid")).where(F.col("_place") <= found.most).drop("_place")
    named = best.join(found.members, "qid").where("vec_id <> query_id")
    return named.withColumn("rank", place("query_id")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The op3 report: queries are the vectors whose vec_id is divisible by ``every``, candidates all vectors."""
    rows = cut(quantised(embeddings))
    return top_k(rows, rows.where(F.col("vec_id") % every == 0), k)


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) as bigint) as score
  from v q, v c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""
