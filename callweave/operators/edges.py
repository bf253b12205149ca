"""Edge filters and the expanded edge view."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.operators.fixpoint import closure, cut, min_dist, spread
from callweave.plans.schema import CONFIDENCES, EDGE_KINDS, EXEC_CONTEXTS, rank, require

COLUMNS = ["caller", "callee", "call_site", "kind", "confidence", "exec_context", "indirection_depth"]


@dataclass(frozen=True)
class EdgeFilter:
    """Kinds and contexts (empty: all), and a least confidence or an explicit set of confidences.

    An explicit but empty set of confidences lets nothing through.  Unknown names are errors.
    """

    edge_kinds: tuple[str, ...] = ()
    min_confidence: str = "Unknown"
    include_confidences: tuple[str, ...] | None = None
    execution_contexts: tuple[str, ...] = ()

    def __post_init__(self):
        for value in self.edge_kinds:
            require(value, EDGE_KINDS, "edge kind")
        for value in (self.min_confidence, *(self.include_confidences or ())):
            require(value, CONFIDENCES, "confidence")
        for value in self.execution_contexts:
            require(value, EXEC_CONTEXTS, "execution context")

    def condition(self) -> Column:
        keep = F.lit(True)
        if self.edge_kinds:
            keep = keep & F.col("kind").isin(*self.edge_kinds)
        if self.execution_contexts:
            keep = keep & F.col("exec_context").isin(*self.execution_contexts)
        if self.include_confidences is not None:
            return keep & (F.col("confidence").isin(*self.include_confidences) if self.include_confidences else F.lit(False))
        return keep if self.min_confidence == "Unknown" else keep & (rank(F.col("confidence")) >= CONFIDENCES.index(self.min_confidence))

    def apply(self, edges: DataFrame) -> DataFrame:
        return edges.where(self.condition())

    @property
    def dispatch(self) -> bool:
        """Whether plausible virtual calls pass."""
        sure = self.min_confidence == "Proven" if self.include_confidences is None else "Plausible" not in self.include_confidences
        return not sure and (not self.edge_kinds or "VirtualDispatch" in self.edge_kinds)


def stored(edge_tus: DataFrame) -> DataFrame:
    """Edges from their registrations: one row for each distinct edge, ``refs`` counts them."""
    return spread(edge_tus, "caller", "call_site").groupBy(*COLUMNS).agg(F.count("*").alias("refs"))


def _plausible_virtual() -> Column:
    return (F.col("kind") == "VirtualDispatch") & (F.col("confidence") == "Plausible")


def override_closure(method_overrides: DataFrame) -> DataFrame:
    """(base_method, override_method) over any number of steps."""
    return closure(method_overrides, "base_method", "override_method")


def synthesized(edges: DataFrame, overrides: DataFrame, function_returns: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Edges that follow from dispatch and from deferred returns, without those that are stored.

    ``overrides`` is the closure.  A plausible virtual call reaches every override of
    its target.  A call through a returned function reaches what the function returns,
    as ThreadEntry if it runs elsewhere, else as FunctionPointer.  One row for each
    (caller, callee, call_site); dispatch wins over returns.  ``others``: stored edges
    to test against where ``edges`` is only part of them.
    """
    virtual = edges.where(_plausible_virtual()).join(overrides, F.col("callee") == F.col("base_method"))
    virtual = virtual.select("caller", F.col("override_method").alias("callee"), *COLUMNS[2:], F.lit(0).alias("_by"))
    deferred = edges.where("kind = 'FunctionPointerReturn'").join(function_returns, F.col("callee") == F.col("func"))
    kind = F.when(F.col("exec_context") != "Synchronous", "ThreadEntry").otherwise("FunctionPointer").alias("kind")
    deferred = deferred.select(
        "caller", F.col("returned_func").alias("callee"), "call_site", kind, "confidence", "exec_context", "indirection_depth", F.lit(1).alias("_by")
    )
    key = ["caller", "callee", "call_site"]
    real = (edges if others is None else others).where("kind <> 'FunctionPointerReturn'").select(*key)
    new = virtual.unionByName(deferred).join(real, key, "left_anti")
    best = new.groupBy(*key).agg(F.min(F.struct("_by", *COLUMNS[3:])).alias("x"))
    return best.select(*key, *[F.col(f"x.{c}") for c in COLUMNS[3:]])


def expanded(edges: DataFrame, method_overrides: DataFrame, function_returns: DataFrame) -> DataFrame:
    """The edge view of every query: stored edges but deferred ones, and the synthesized ones."""
    plain = edges.where("kind <> 'FunctionPointerReturn'").select(*COLUMNS)
    return plain.unionByName(synthesized(edges, override_closure(method_overrides), function_returns))


def _meeting(many: DataFrame, few: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a large table that have a key of ``few``, and perhaps some others: of the large table only hashes of keys travel."""
    h = F.xxhash64(*key).alias("_h")
    met = cut(many.select(h).join(few.select(h).hint("shuffle_hash"), "_h", "left_semi").distinct())
    if met.isEmpty():
        return many.limit(0)
    return many.withColumn("_h", h).join(met, "_h", "left_semi").drop("_h")


_KEY, _AT = ["caller", "callee", "call_site"], ["caller", "call_site"]


class View:
    """The expanded view in parts, from edges (or their registrations: rows may repeat), without a row for each call and override.

    ``plain``: stored edges.  ``deferred``: through what functions return.  ``whole``:
    plausible virtual calls, each standing for one edge to every override of its
    callee; ``single``: such edges, one by one, where several edges of a (caller,
    call_site) have a say in one of them.  No edge is in two parts.
    """

    def __init__(self, edges: DataFrame, method_overrides: DataFrame, function_returns: DataFrame):
        self.edges, self.overrides, self.returns = edges.select(*COLUMNS), method_overrides, function_returns

    @property
    def plain(self) -> DataFrame:
        return self.edges.where("kind <> 'FunctionPointerReturn'")

    @cached_property
    def closed(self) -> DataFrame:
        return override_closure(self.overrides)

    @cached_property
    def deferred(self) -> DataFrame:
        calls = spread(self.edges.where("kind = 'FunctionPointerReturn'"), "callee").join(self.returns, F.col("callee") == F.col("func"))
        kind = F.when(F.col("exec_context") != "Synchronous", "ThreadEntry").otherwise("FunctionPointer").alias("kind")
        calls = calls.select("caller", F.col("returned_func").alias("callee"), "call_site", F.struct(kind, *COLUMNS[4:]).alias("x"))
        new = cut(calls.groupBy(*_KEY).agg(F.min("x").alias("x")).select(*_KEY, "x.*"))
        new = new.join(_meeting(self.plain.select(*_KEY), new, _KEY), _KEY, "left_anti")
        # Dispatch wins over returns.
        virtual = self.edges.where(_plausible_virtual()).select(*_AT, F.col("callee").alias("base_method"))
        virtual = cut(_meeting(virtual, new, _AT))
        if not virtual.isEmpty():
            below = self.closed.withColumnRenamed("override_method", "callee")
            new = new.join(new.join(virtual, _AT).join(below, ["base_method", "callee"]), _KEY, "left_anti")
        return cut(new)

    @cached_property
    def _virtual(self) -> tuple[DataFrame, DataFrame]:
        rest = ["exec_context", "indirection_depth"]
        virtual = cut(spread(self.edges.where(_plausible_virtual()).select(*_AT, "callee", *rest), *_AT).distinct())
        others = self.plain.select(*_AT, F.col("callee").alias("_other"), _plausible_virtual().alias("_v"))
        pairs = spread(others, *_AT).join(virtual, _AT).where("callee <> _other").select(*_AT, F.col("callee").alias("base_method"), "_other", "_v")
        pairs = cut(pairs.distinct())
        # An edge that is stored or reached from another call of the place, ...
        meet = pairs.join(self.closed.withColumnRenamed("override_method", "_other"), ["base_method", "_other"], "left_semi").select(*_AT)
        # ... a callee in several contexts, ...
        meet = meet.union(virtual.groupBy(*_AT, "callee").agg(F.count("*").alias("_n")).where("_n > 1").select(*_AT))
        # ... two callees with an override in common, which only one of several bases can be.
        several = self.overrides.where("base_method <> override_method").distinct().groupBy("override_method").agg(F.count("*").alias("_n")).where("_n > 1")
        above = cut(self.closed.join(several, "override_method", "left_semi").select("base_method").distinct())
        if not above.isEmpty():
            both = pairs.where("_v").join(above, "base_method", "left_semi").join(above.withColumnRenamed("base_method", "_other"), "_other", "left_semi")
            meet = meet.union(both.select(*_AT))
        meet = cut(meet.distinct())
        whole = virtual.join(meet, _AT, "left_anti").select(*_KEY, F.lit("VirtualDispatch").alias("kind"), F.lit("Plausible").alias("confidence"), *rest)
        new = virtual.join(meet, _AT, "left_semi").withColumnRenamed("callee", "base_method").join(self.closed, "base_method")
        new = new.groupBy(*_AT, F.col("override_method").alias("callee")).agg(F.min(F.struct(*rest)).alias("x"))
        real = others.join(meet, _AT, "left_semi").select(*_AT, F.col("_other").alias("callee"))
        new = new.join(real, _KEY, "left_anti")
        return whole, cut(new.select(*_KEY, F.lit("VirtualDispatch").alias("kind"), F.lit("Plausible").alias("confidence"), *[F.col(f"x.{c}") for c in rest]))

    @property
    def whole(self) -> DataFrame:
        return self._virtual[0]

    @property
    def single(self) -> DataFrame:
        return self._virtual[1]

    def narrow(self, where: EdgeFilter) -> DataFrame:
        """The edges of a filter that lets no plausible virtual call through; rows may repeat where they do in the edges."""
        if where.dispatch:
            raise ValueError("the filter asks for dispatch")
        return where.apply(self.plain.unionByName(self.deferred))

    def counts(self, *by: str) -> DataFrame:
        """(by, n, chars): number of the view's edges, and characters of their callees, by some of the edges' columns but ``callee``, or by that alone."""
        plain = spread(self.plain, *_AT).distinct()
        found = plain.unionByName(self.deferred).unionByName(self.single).groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.length("callee")).alias("chars"))
        keys = [*by, F.col("callee").alias("base_method")] if by != ("callee",) else [F.col("callee").alias("base_method")]
        calls = self.whole.groupBy(*keys).agg(F.count("*").alias("_c"))
        if by == ("callee",):
            below = spread(self.closed, "base_method").select("base_method", F.col("override_method").alias("callee"), F.lit(1).alias("n"), F.length("override_method").alias("chars"))
        else:
            below = spread(self.closed, "base_method").groupBy("base_method").agg(F.count("*").alias("n"), F.sum(F.length("override_method")).alias("chars"))
        calls = calls.join(below, "base_method").groupBy(*by).agg(F.sum(F.col("_c") * F.col("n")).alias("n"), F.sum(F.col("_c") * F.col("chars")).alias("chars"))
        return found.unionByName(calls).groupBy(*by).agg(F.sum("n").alias("n"), F.sum("chars").cast("long").alias("chars"))


def callees(edges: DataFrame, method_overrides: DataFrame, function_returns: DataFrame, caller: str, where: EdgeFilter = EdgeFilter()) -> DataFrame:
    """Expanded edges out of one function; overrides are followed from what it calls alone."""
    own = edges.where(F.col("caller") == caller)
    starts = own.where(_plausible_virtual()).select(F.col("callee").alias("base_method"), F.col("callee").alias("node")).distinct()
    steps = method_overrides.select(F.col("base_method").alias("src"), F.col("override_method").alias("dst"))
    below = min_dist(starts, steps, key="base_method").where("dist > 0").select("base_method", F.col("node").alias("override_method"))
    plain = own.where("kind <> 'FunctionPointerReturn'").select(*COLUMNS)
    return where.apply(plain.unionByName(synthesized(own, below, function_returns)))


def callers(edges: DataFrame, method_overrides: DataFrame, function_returns: DataFrame, callee: str, where: EdgeFilter = EdgeFilter()) -> DataFrame:
    """Expanded edges into one function: direct ones, dispatch through its bases, and calls through what returns it.

    Overrides are followed upwards from the function alone.
    """
    steps = method_overrides.select(F.col("override_method").alias("src"), F.col("base_method").alias("dst"))
    above = min_dist(edges.sparkSession.createDataFrame([(callee,)], ["node"]), steps).where("dist > 0")
    above = above.select(F.col("node").alias("base_method"), F.lit(callee).alias("override_method"))
    back = function_returns.where(F.col("returned_func") == callee)
    targets = above.select(F.col("base_method").alias("callee")).union(back.select("func")).union(above.sparkSession.createDataFrame([(callee,)], ["callee"]))
    part = edges.join(targets.distinct(), "callee", "left_semi")
    direct = part.where((F.col("callee") == callee) & (F.col("kind") != "FunctionPointerReturn")).select(*COLUMNS)
    return where.apply(direct.unionByName(synthesized(part, above, back)))


def materialised(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with ``caller_name`` and ``callee_name``: display names, or the usr of functions without a node."""
    name = lambda side: nodes.select(F.col("usr").alias(side), F.col("qualified_name").alias(f"{side}_name"))
    both = rows.join(name("caller"), "caller", "left").join(name("callee"), "callee", "left")
    return both.select(*rows.columns, *[F.coalesce(f"{s}_name", s).alias(f"{s}_name") for s in ("caller", "callee")])


def projected(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``materialised`` edges for an answer: what is at its default is null, so that it is left out of JSON."""
    unless = lambda c, default: F.when(F.col(c) != default, F.col(c)).alias(c)
    shown = materialised(rows, nodes)
    special = {"indirection_depth": unless("indirection_depth", 0), "exec_context": unless("exec_context", "Synchronous")}
    return shown.select(*[special.get(c, F.col(c)) for c in shown.columns])


def in_degree(edges: DataFrame) -> DataFrame:
    """(callee, in_degree): stored edges into each function, deferred ones included."""
    return edges.groupBy("callee").agg(F.count("*").alias("in_degree"))


def hubs(edges: DataFrame, max_fan_in: int) -> DataFrame:
    """Functions with more stored callers than ``max_fan_in``; none if it is 0."""
    return in_degree(edges).where(F.col("in_degree") > max_fan_in if max_fan_in else F.lit(False))


def collapse(path: Column, patterns: list[str]) -> Column:
    """Whether a path has one of the patterns between slashes of its own; the last segment, the file, has none after it."""
    hit = F.lit(False)
    for p in patterns:
        p = p if not p or p.startswith("/") else f"/{p}"
        hit = hit | F.contains(path, F.lit(p if not p or p.endswith("/") else f"{p}/"))
    return hit


def collapsed(edges: DataFrame, nodes: DataFrame, patterns: list[str]) -> DataFrame:
    """Edges but those whose ends are both in collapsed files."""
    files = nodes.select("usr", collapse(F.col("file"), patterns).alias("_in"))
    a = files.select(F.col("usr").alias("caller"), F.col("_in").alias("_a"))
    b = files.select(F.col("usr").alias("callee"), F.col("_in").alias("_b"))
    both = edges.join(a, "caller", "left").join(b, "callee", "left")
    return both.where(~(F.coalesce("_a", F.lit(False)) & F.coalesce("_b", F.lit(False)))).select(*edges.columns)


# Prefixes and parts of paths of system headers.
SYSTEM_PREFIXES = (
    "/usr/include/",
    "/usr/lib/",
    "/usr/local/include/",
    "/usr/local/lib/",
    "/Library/Developer/",
    "/Applications/Xcode.app/",
    "/opt/homebrew/",
)
SYSTEM_PARTS = ("/lib/clang/", "/lib/gcc/")


def is_system_path(path: Column) -> Column:
    hit = F.lit(False)
    for p in SYSTEM_PREFIXES:
        hit = hit | path.startswith(p)
    for p in SYSTEM_PARTS:
        hit = hit | F.contains(path, F.lit(p))
    return hit


def skip_paths(rows: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """Rows whose path has none of the patterns."""
    return rows.where(~collapse(F.col(column), patterns))
