"""From names to functions: candidates, the identity contract, search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Candidates that an ambiguous answer lists.
LISTED = 25


def unqualified(name: Column) -> Column:
    """What follows the last ``::``."""
    return F.substring_index(name, "::", -1)


def candidates(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(usr) that a name may mean: the node with that usr, else those with that display name, else any edge's end."""
    by_usr = nodes.where(F.col("usr") == name).select("usr", F.lit(0).alias("by"))
    by_name = nodes.where(F.col("qualified_name") == name).select("usr", F.lit(1).alias("by"))
    ends = edges.where((F.col("caller") == name) | (F.col("callee") == name)).limit(1)  # one row shows that it exists
    by_end = ends.select(F.lit(name).alias("usr"), F.lit(2).alias("by"))
    found = by_usr.unionByName(by_name).unionByName(by_end)
    best = found.agg(F.min("by").alias("best"))
    return found.join(F.broadcast(best), F.col("by") == F.col("best")).select("usr").distinct()


def find_node(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """The node of a name; of several the one with the least usr."""
    return nodes.join(candidates(nodes, edges, name), "usr").orderBy("usr").limit(1)


@dataclass(frozen=True)
class Resolved:
    usr: str


@dataclass(frozen=True)
class Ambiguous:
    """No error: candidates by usr (the first ``LISTED``), their number, and per file counts where the list is cut."""

    candidates: DataFrame
    total: int
    by_file: DataFrame

    @property
    def truncated(self) -> bool:
        return self.total > LISTED


def ambiguous(nodes: DataFrame, usrs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The listed candidates and the counts by file over all of them."""
    known = nodes.join(usrs, "usr", "left_semi")
    listed = usrs.join(nodes, "usr", "left").orderBy("usr").limit(LISTED)
    return listed, known.groupBy("file").agg(F.count("*").alias("n"))


def resolve(
    nodes: DataFrame, edges: DataFrame, call_sites: DataFrame | None = None, name: str = "", usr: str = "", site: str = "", narrow: str = ""
) -> Resolved | Ambiguous:
    """One function from a usr, or a call site (and name), or a name.

    Several candidates are narrowed by ``narrow``, a literal part of usr, name or
    file; if exactly one is left it is the answer, if none is left all are shown.
    Missing arguments and unknown names are ``ValueError``.
    """
    if usr:
        return Resolved(usr)
    if site:
        if call_sites is None:
            raise ValueError("no call sites to resolve a site with")
        at = call_sites.where(F.col("call_site") == site)
        at = at.where((F.col("callee_name") == name) | (F.col("callee_usr") == name)) if name else at
        found = at.select(F.col("callee_usr").alias("usr")).distinct()
    elif name:
        found = candidates(nodes, edges, name)
    else:
        raise ValueError("name, usr or site is needed")
    some = [r.usr for r in found.orderBy("usr").limit(2).collect()]
    if not some:
        raise ValueError(f"unknown function: {name or site}")
    if len(some) == 1:
        return Resolved(some[0])
    if narrow:
        has = lambda c: F.contains(F.coalesce(c, F.lit("")), F.lit(narrow))
        left = found.join(nodes, "usr", "left").where(has("usr") | has("qualified_name") | has("file")).select("usr").distinct()
        kept = [r.usr for r in left.orderBy("usr").limit(2).collect()]
        if len(kept) == 1:
            return Resolved(kept[0])
        found = left if kept else found
    listed, by_file = ambiguous(nodes, found)
    return Ambiguous(listed, found.count(), by_file)


def by_name(rows: DataFrame, name: str, column: str = "qualified_name") -> DataFrame:
    """All declarations of a name: overloads, guides and specialisations (by ``template_name``), initialisers, summaries."""
    return rows.where(F.col(column) == name)


def methods_of(rows: DataFrame, class_name: str) -> DataFrame:
    """The methods of a class among rows with ``enclosing_class``."""
    return by_name(rows, class_name, "enclosing_class")


def classes_for(effective_impls: DataFrame, nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(concrete_class) of the classes that a method, by usr or name, is the implementation for."""
    usrs = candidates(nodes, edges, name).select(F.col("usr").alias("impl_method"))
    return effective_impls.join(usrs, "impl_method", "left_semi").select("concrete_class").distinct()


def entry_points(nodes: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(name, usr, qualified_name, file, line) of the graph's entry points, or of configured names; unknown ones have nulls."""
    shown = nodes.select("usr", "qualified_name", "file", "line")
    if not names:
        return nodes.where("is_entry_point").select(F.col("qualified_name").alias("name"), "usr", "qualified_name", "file", "line")
    wanted = nodes.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
    # A handful of configured names.
    hits = shown.join(F.broadcast(wanted), (F.col("usr") == F.col("name")) | (F.col("qualified_name") == F.col("name")))
    return wanted.join(hits, "name", "left").select("name", "usr", "qualified_name", "file", "line")


def search(nodes: DataFrame, query: str, limit: int = 25) -> DataFrame:
    """Functions whose name contains the query in any case: exact unqualified names, then prefixes, then the rest.

    Adds ``total_matches``; ties by length of the name, name and usr.
    """
    if not query or limit < 1:
        raise ValueError("a query and a limit of 1 or more are needed")
    needle = query.lower()
    hits = nodes.withColumn("_q", F.lower("qualified_name")).where(F.contains("_q", F.lit(needle)))
    last = unqualified(F.col("_q"))
    tier = F.when(last == needle, 0).when(last.startswith(needle), 1).otherwise(2)
    total = hits.agg(F.count("*").alias("total_matches"))
    top = hits.withColumn("tier", tier).orderBy("tier", F.length("qualified_name"), "qualified_name", "usr").limit(limit)
    return top.drop("_q").crossJoin(F.broadcast(total))  # one row with the count
