"""Whole-graph summaries, class hierarchies, callback and thread entry lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators.edges import EdgeFilter
from callweave.operators.fixpoint import closure
from callweave.plans.schema import CONFIDENCES, RESULT_KINDS


def histogram(expanded: DataFrame, column: str) -> DataFrame:
    """(column, n) with a row for every value of the enumeration, zero where there is none."""
    return filled(expanded.groupBy(column).agg(F.count("*").alias("n")), column)


def filled(counts: DataFrame, column: str) -> DataFrame:
    """``histogram`` from counts (column, n)."""
    values = CONFIDENCES if column == "confidence" else RESULT_KINDS
    domain = counts.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return domain.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def top(expanded: DataFrame, nodes: DataFrame, side: str, k: int = 5) -> DataFrame:
    """(name, n): display names with most expanded edges out (``caller``) or in (``callee``); ties by name."""
    return first(expanded.groupBy(side).agg(F.count("*").alias("n")), nodes, side, k)


def first(per_usr: DataFrame, nodes: DataFrame, side: str, k: int = 5) -> DataFrame:
    """``top`` from counts (side, n)."""
    named = per_usr.join(nodes.select(F.col("usr").alias(side), "qualified_name"), side, "left")
    named = named.select(F.coalesce("qualified_name", side).alias("name"), "n")
    return named.groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(k)


def totals(nodes: DataFrame, expanded: DataFrame, call_sites: DataFrame) -> DataFrame:
    """One row: node_count, edge_count, call_site_count, entry_point_count."""
    return sizes(nodes, expanded.groupBy("caller").agg(F.count("*").alias("n")), call_sites)


def sizes(nodes: DataFrame, per_caller: DataFrame, call_sites: DataFrame) -> DataFrame:
    """``totals`` from counts (caller, n)."""
    registered = per_caller.join(nodes.select(F.col("usr").alias("caller")), "caller", "left_semi")
    parts = [
        nodes.agg(F.count("*").alias("node_count"), F.count_if("is_entry_point").alias("entry_point_count")),
        registered.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edge_count")),
        call_sites.agg(F.count("*").alias("call_site_count")),
    ]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # three single rows


def callback_sites(expanded: DataFrame, nodes: DataFrame, prefix: str = "") -> DataFrame:
    """(target, site_count, sites) of functions that are called back; ``sites`` are (call_site, caller, kind), in order.

    A target's sites are shown whole: the list is as long as its callers' calls.
    """
    rows = EdgeFilter(("FunctionPointer", "LambdaCall")).apply(expanded)
    rows = rows.join(nodes.select(F.col("usr").alias("callee"), "qualified_name"), "callee", "left")
    rows = rows.select(F.coalesce("qualified_name", "callee").alias("target"), F.struct("call_site", "caller", "kind").alias("site"))
    rows = rows.where(F.col("target").startswith(prefix)) if prefix else rows
    return rows.groupBy("target").agg(F.count("*").alias("site_count"), F.array_sort(F.collect_list("site")).alias("sites"))


def concurrency_entry_points(expanded: DataFrame, contexts: tuple[str, ...] = ()) -> DataFrame:
    """Expanded edges that start threads or tasks."""
    return EdgeFilter(("ThreadEntry",), execution_contexts=contexts).apply(expanded)


def derived_classes(derived: DataFrame, transitive: bool = False) -> DataFrame:
    """(base, derived), over any number of steps if ``transitive``; distinct under diamonds."""
    return closure(derived, "base", "derived") if transitive else derived.distinct()


def virtual_overrides(nodes: DataFrame, overrides: DataFrame, class_name: str) -> DataFrame:
    """(base_method, override_method) of the virtual methods of a class."""
    own = nodes.where((F.col("enclosing_class") == class_name) & F.col("is_virtual")).select(F.col("usr").alias("base_method"))
    return overrides.join(own, "base_method", "left_semi")
