"""Merge algebra and incremental maintenance of fact tables by unit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.functions.scalars import set_fingerprint

from callweave.operators.edges import COLUMNS as EDGE_KEY
from callweave.operators.fixpoint import cut, spread

#: Tables with set semantics and the key of an entry; the first entry wins.
SETS = {
    "odr_entries": ["qualified_name", "signature", "is_class", "file_path", "line", "odr_hash"],
    "default_args": ["qualified_name", "signature", "param_index", "default_text", "file_path", "line"],
    "exception_specs": ["qualified_name", "signature", "is_noexcept", "file_path", "line"],
    "specializations": ["template_name", "args_string", "header_path", "line"],
    "derived_classes": ["base", "derived"],
    "method_overrides": ["base_method", "override_method"],
    "effective_impls": ["impl_method", "concrete_class"],
    "function_returns": ["func", "returned_func"],
}
#: Tables that simply add up.
BAGS = ("overloads", "deduction_guides", "coverage_props", "call_sites", "edge_tus", "channel_site_tus", "node_tus")


def merge_nodes(shards: list[DataFrame]) -> DataFrame:
    """Nodes of shards in order: first name, last non-empty file and class, last line that isn't 0, flags united."""
    rows = shards[0].withColumn("_s", F.lit(0))
    for i, shard in enumerate(shards[1:], 1):
        rows = rows.unionByName(shard.withColumn("_s", F.lit(i)))
    last = lambda c, empty: F.coalesce(F.max_by(c, F.when(F.col(c) != empty, F.struct("_s", c))), F.lit(empty)).alias(c)
    return rows.groupBy("usr").agg(
        F.min_by("qualified_name", F.struct("_s", "qualified_name")).alias("qualified_name"),
        last("file", ""),
        last("line", 0),
        F.bool_or("is_entry_point").alias("is_entry_point"),
        F.bool_or("is_virtual").alias("is_virtual"),
        last("enclosing_class", ""),
    )


def merge_summaries(shards: list[DataFrame]) -> DataFrame:
    """Function summaries by name: flags united, lists united in order, first site wins."""
    rows = shards[0].withColumn("_s", F.lit(0))
    for i, shard in enumerate(shards[1:], 1):
        rows = rows.unionByName(shard.withColumn("_s", F.lit(i)))
    order = F.struct("_s", "file_path", "line")
    lists = ["called_functions", "unguarded_calls", "referenced_globals"]
    united = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_s", "file_path", "line", c))), lambda x: x[c]))).alias(c)
    return rows.groupBy("qualified_name").agg(
        F.min_by("file_path", order).alias("file_path"),
        F.min_by("line", order).alias("line"),
        F.bool_or("is_noexcept").alias("is_noexcept"),
        F.bool_or("has_uncaught_throw").alias("has_uncaught_throw"),
        *[united(c) for c in lists],
    )


def absorb(table: str, shards: list[DataFrame]) -> DataFrame:
    """One table from the same table of several shards."""
    if table == "nodes":
        return merge_nodes(shards)
    if table == "fn_summaries":
        return merge_summaries(shards)
    both = shards[0]
    for shard in shards[1:]:
        both = both.unionByName(shard)
    return both.dropDuplicates(SETS[table]) if table in SETS else both


def remove_tus(edge_tus: DataFrame, tus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registrations without those of the units (tu_path), and the edges that are gone with them."""
    left = edge_tus.join(tus, "tu_path", "left_anti")
    marked = edge_tus.join(tus.select("tu_path").distinct().withColumn("_gone", F.lit(True)), "tu_path", "left")
    # One grouping: an edge is gone if all its registrations are.
    counted = spread(marked, "caller", "call_site").groupBy(*EDGE_KEY).agg(F.count("*").alias("refs"), F.count("_gone").alias("_n"))
    return left, counted.where("refs = _n").drop("_n")


def units(spark: SparkSession, tus: list[str]) -> DataFrame:
    """(tu_path) of a list of units."""
    return spark.createDataFrame([(t,) for t in tus], "tu_path string")


def remove_call_sites(call_sites: DataFrame, tus: DataFrame) -> DataFrame:
    """Contexts but those of the units (tu_path); those that name no unit go by the file of their site."""
    owner = F.when(F.col("tu_path") == "", F.regexp_extract("call_site", "^(.+):[0-9]+:[0-9]+$", 1)).otherwise(F.col("tu_path"))
    return call_sites.withColumn("_owner", owner).join(tus.select(F.col("tu_path").alias("_owner")), "_owner", "left_anti").select(*call_sites.columns)


#: Tables whose rows count registrations of units, and the table of those.
COUNTED = {"edges": "edge_tus", "channel_sites": "channel_site_tus"}


def _recounted(old: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """A counted table after its registrations changed; rows that never had any stay as they are.

    Registrations may be flat in other columns than the table's; both have the key in common.
    """
    key = [c for c in old.columns if c != "refs"]
    untagged = spread(old, *key).join(spread(before.select(*key), *key), key, "left_anti") if not before.isEmpty() else old
    return untagged.unionByName(spread(after, *key).groupBy(*key).agg(F.count("*").alias("refs")))


def apply_delta(tables: dict[str, DataFrame], tus: str | list[str] | DataFrame, facts: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Tables after some units were indexed again: their old rows go, the new rows ``facts`` come.

    Units without facts are removed.  A node goes with the last unit that contributed
    to it; nodes that never had one stay.  Edges and channel sites are counted again
    from their registrations.  Class and override relations are only added to.
    """
    facts = facts or {}
    spark = next(iter(tables.values())).sparkSession
    tus = units(spark, [tus] if isinstance(tus, str) else tus) if isinstance(tus, (str, list)) else tus.select("tu_path").distinct()
    out = dict(tables)
    for name, old in tables.items():
        if name in COUNTED or name in SETS or name in ("nodes", "fn_summaries"):
            continue
        if name == "call_sites":
            out[name] = remove_call_sites(old, tus)
        elif "tu_path" in old.columns:
            out[name] = old.join(tus, "tu_path", "left_anti").select(*old.columns)
    for name, new in facts.items():
        out[name] = absorb(name, [out[name], new]) if name in out else new
    if "nodes" in tables and "node_tus" in tables:
        # Contributed once, by nobody now.
        gone = tables["node_tus"].select("usr").distinct().join(out["node_tus"].select("usr").distinct(), "usr", "left_anti")
        kept = tables["nodes"].join(gone, "usr", "left_anti")
        out["nodes"] = absorb("nodes", [kept, facts["nodes"]]) if "nodes" in facts else kept
    for name, registrations in COUNTED.items():
        if name in tables and registrations in tables:
            out[name] = _recounted(tables[name], tables[registrations], out[registrations]).select(*tables[name].columns)
    return out


def warm_start(
    tables: dict[str, DataFrame], old: DataFrame, new: DataFrame, index: Callable[[list[str]], dict[str, DataFrame]], same_config: bool = True
) -> tuple[str, dict[str, DataFrame] | None]:
    """("rebuild" | "unchanged" | "refreshed", tables): a snapshot brought up to date by its files' stamps (path, mtime_ns, size).

    Another configuration asks for a rebuild.  Dropped files are removed, new and
    changed ones come from ``index``; without any there is nothing to save again.
    ``index`` works through a list on the driver; ``refresh`` is for one that is a plan.
    """

    def listed(fresh: DataFrame) -> dict[str, DataFrame]:
        paths = sorted(r.path for r in fresh.collect())  # files to index again, a list the caller works through
        return index(paths) if paths else {}

    return refresh(tables, old, new, listed, same_config)


def refresh(
    tables: dict[str, DataFrame], old: DataFrame, new: DataFrame, index: Callable[[DataFrame], dict[str, DataFrame]], same_config: bool = True
) -> tuple[str, dict[str, DataFrame] | None]:
    """``warm_start`` where ``index`` takes the new and changed files as a table (path): no list of files reaches the driver."""
    if not same_config:
        return "rebuild", None
    stale = cut(stamp_diff(old, new).where("state <> 'same'"))
    if stale.isEmpty():
        return "unchanged", tables
    return "refreshed", apply_delta(tables, stale.select(F.col("path").alias("tu_path")), index(stale.where("state <> 'dropped'").select("path")))


def compact(tables: dict[str, DataFrame], rows: int = 1_000_000) -> dict[str, DataFrame]:
    """The same rows in as few partitions as hold ``rows`` each; queries see no difference."""
    return {name: df.coalesce(max(1, -(-df.count() // rows))) for name, df in tables.items()}


def entry_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of every table, and of the distinct names where functions, classes and templates are listed."""
    out = None
    for name, df in sorted(tables.items()):
        row = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def stamp_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state): new, dropped, changed or same, from two sets of stamps."""
    a = old.select("path", F.struct("mtime_ns", "size").alias("a"))
    b = new.select("path", F.struct("mtime_ns", "size").alias("b"))
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "dropped").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def attempts(journal: DataFrame, done: str = "done") -> DataFrame:
    """(tu_path, stamp, attempts): records of each unit's latest stamp since it last completed.

    ``journal``: (seq, tu_path, stamp, state); ``done`` is the state of completion.
    """
    by_tu = Window.partitionBy("tu_path")
    rows = journal.withColumn("_last", F.max(F.struct("seq", "stamp")).over(by_tu)["stamp"]).where(F.col("stamp").eqNullSafe(F.col("_last")))
    rows = rows.withColumn("_done", F.max(F.when(F.col("state") == done, F.col("seq"))).over(by_tu))
    since = (F.col("_done").isNull() | (F.col("seq") > F.col("_done"))) & (F.col("state") != done)
    return rows.groupBy("tu_path", "stamp").agg(F.count_if(since).alias("attempts"))


def replayable(journal: DataFrame, stamps: DataFrame, poison_after: int = 2) -> DataFrame:
    """(tu_path, action): reuse (completed at the present stamp), skip (too many attempts) or index."""
    tried = attempts(journal)
    latest = journal.groupBy("tu_path").agg(F.max_by("state", "seq").alias("state"), F.max_by("stamp", "seq").alias("stamp"))
    now = stamps.select("tu_path", F.col("stamp").alias("now"))
    both = now.join(latest, "tu_path", "left").join(tried.select("tu_path", "attempts"), "tu_path", "left")
    same = F.col("stamp").isNotNull() & (F.col("stamp") == F.col("now"))
    action = F.when(same & (F.col("state") == "done"), "reuse").when(same & (F.coalesce("attempts", F.lit(0)) >= poison_after), "skip").otherwise("index")
    return both.select("tu_path", action.alias("action"))


def whole_set_valid(then: DataFrame, now: DataFrame) -> bool:
    """Whether a result over a set of files (path, mtime_ns, size) still holds: the sets' digests are equal."""
    a, b = (s.agg(set_fingerprint().alias("x")).first().x for s in (then, now))
    return a == b


def build_stats(stats: DataFrame) -> DataFrame:
    """(phase, n, failed, total_ms, max_ms) over build statistics."""
    return stats.groupBy("phase").agg(
        F.count("*").alias("n"), F.count_if(F.col("tool_status") != 0).alias("failed"), F.sum("ms").alias("total_ms"), F.max("ms").alias("max_ms")
    )


def slowest(stats: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` slowest (file, ms) over all phases."""
    return stats.groupBy("file").agg(F.sum("ms").alias("ms")).orderBy(F.desc("ms"), "file").limit(k)


def digest(stats: DataFrame) -> DataFrame:
    """(phase, n, min_ms, median_ms, max_ms, avg_ms) over build statistics or repeated timings."""
    ms = F.col("ms").cast("double")
    return stats.groupBy("phase").agg(
        F.count("*").alias("n"), F.min(ms).alias("min_ms"), F.median(ms).alias("median_ms"), F.max(ms).alias("max_ms"), F.avg(ms).alias("avg_ms")
    )


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(phase, a_ms, b_ms, delta_pct) of two runs' totals."""
    total = lambda d, n: d.groupBy("phase").agg(F.sum("ms").alias(n))
    both = total(a, "a_ms").join(total(b, "b_ms"), "phase", "full_outer")
    return both.withColumn("delta_pct", F.when(F.col("a_ms") > 0, (F.col("b_ms") - F.col("a_ms")) * 100.0 / F.col("a_ms")))
