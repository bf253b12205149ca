"""Exception and lock context along paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.operators.contexts import first_by
from callweave.operators.fixpoint import cut

# The standard exceptions and their bases.
STANDARD_BASES = {
    "std::bad_alloc": "std::exception",
    "std::bad_cast": "std::exception",
    "std::bad_typeid": "std::exception",
    "std::bad_function_call": "std::exception",
    "std::bad_weak_ptr": "std::exception",
    "std::bad_array_new_length": "std::bad_alloc",
    "std::logic_error": "std::exception",
    "std::runtime_error": "std::exception",
    "std::domain_error": "std::logic_error",
    "std::invalid_argument": "std::logic_error",
    "std::length_error": "std::logic_error",
    "std::out_of_range": "std::logic_error",
    "std::overflow_error": "std::runtime_error",
    "std::underflow_error": "std::runtime_error",
    "std::range_error": "std::runtime_error",
    "std::system_error": "std::runtime_error",
    "std::ios_base::failure": "std::system_error",
    "std::filesystem::filesystem_error": "std::system_error",
}


def bare_type(name: str) -> str:
    """Without a trailing reference, a leading const and blanks."""
    return name.strip().removesuffix("&").removeprefix("const ").strip()


def bare(name: Column) -> Column:
    """``bare_type`` of a column."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(name), "&$", ""), "^const ", ""))


def hierarchy(derived_classes: DataFrame) -> dict[str, str]:
    """A base of each class of (base, derived), for ``more`` of the tests below; of several the least name.

    Class hierarchies of exceptions are small; the caller passes those that matter.
    """
    first = derived_classes.groupBy("derived").agg(F.min("base").alias("base"))
    return {r.derived: r.base for r in first.collect()}


def bases(exception: str, more: dict[str, str] | None = None) -> list[str]:
    """The type itself and every known base."""
    known, at, out = STANDARD_BASES | (more or {}), bare_type(exception), []
    while at and at not in out:
        out.append(at)
        at = known.get(at, "")
    return out


def catches(handlers: Column, exception: str, more: dict[str, str] | None = None) -> Column:
    """Whether one of a scope's handlers takes the exception; any scope does for no type."""
    names = bases(exception, more)
    return F.exists(handlers, lambda h: h["is_catch_all"] | bare(h["caught_type"]).isin(*names))


def hops(paths: DataFrame) -> DataFrame:
    """(rank, pos, length, caller, callee, call_site) for every hop; a path without hops has one row of nulls."""
    flat = paths.select("rank", "length", F.posexplode_outer("hops").alias("pos", "hop"))
    return flat.select("rank", "length", "pos", "hop.caller", "hop.callee", "hop.call_site")


def with_contexts(paths: DataFrame, call_sites: DataFrame) -> DataFrame:
    """Hops with the first context of their (caller, callee); hops without one are unprotected."""
    rows = cut(hops(paths))
    wanted = rows.select(F.col("caller").alias("caller_usr"), F.col("callee").alias("callee_usr")).distinct()
    known = first_by(call_sites.join(F.broadcast(wanted), ["caller_usr", "callee_usr"], "left_semi"), "caller_usr", "callee_usr")
    known = known.select("caller_usr", "callee_usr", "try_scopes", "guards", "caller_noexcept")
    return rows.join(known, (F.col("caller") == F.col("caller_usr")) & (F.col("callee") == F.col("callee_usr")), "left")


def path_contexts(paths: DataFrame, call_sites: DataFrame) -> DataFrame:
    """(rank, length, scopes, guards, has_noexcept_barrier) of each path, in order from the entry."""
    rows = with_contexts(paths, call_sites)
    item = F.struct("pos", "try_scopes", "guards")
    both = rows.groupBy("rank", "length").agg(
        F.array_sort(F.collect_list(item)).alias("x"), F.coalesce(F.bool_or(F.col("caller_noexcept") == "Noexcept"), F.lit(False)).alias("has_noexcept_barrier")
    )
    joined = lambda c: F.flatten(F.filter(F.transform("x", lambda h: h[c]), lambda v: v.isNotNull()))
    return both.select("rank", "length", joined("try_scopes").alias("scopes"), joined("guards").alias("guards"), "has_noexcept_barrier")


def protection(paths: DataFrame, call_sites: DataFrame, exception: str = "", more: dict[str, str] | None = None) -> DataFrame:
    """(rank, length, caught, caught_at, caught_by) of each path: the first scope from the entry that takes the exception.

    ``caught_by`` is the type of the first of its handlers that does, ``...`` for one of everything.
    """
    rows = path_contexts(paths, call_sites)
    takes = lambda s: catches(s["handlers"], exception, more) if exception else F.lit(True)
    first = F.get(F.filter("scopes", takes), 0)
    names = bases(exception, more) or [""]
    by = F.get(F.filter(first["handlers"], lambda h: h["is_catch_all"] | F.lit(not exception) | bare(h["caught_type"]).isin(*names)), 0)
    rows = rows.withColumn("_by", F.when(by["is_catch_all"], "...").otherwise(by["caught_type"]))
    return rows.select("rank", "length", first.isNotNull().alias("caught"), F.coalesce(first["try_location"], F.lit("")).alias("caught_at"), F.coalesce("_by", F.lit("")).alias("caught_by"))


def verdict(rated: DataFrame, paths: DataFrame | None = None, function: str = "", exception: str = "") -> DataFrame:
    """One row: protection (always, sometimes, never, unknown), total and caught paths, a sentence.

    The sentence names the first handler where every path is caught, and (with ``paths``)
    the first path that is not where some are.
    """
    none = F.lit(None).cast("array<string>")
    rows = rated.withColumn("nodes", none) if paths is None else rated.join(paths.select("rank", "nodes"), "rank")
    n, caught = F.count("*"), F.count_if("caught")
    first = F.min_by(F.struct("caught_by", "caught_at"), "rank")
    uncaught = F.min_by("nodes", F.when(~F.col("caught"), F.col("rank")))
    found = rows.agg(n.alias("total_paths"), caught.alias("caught_paths"), first.alias("_first"), F.array_join(uncaught, " -> ").alias("_open"))
    total, caught = F.col("total_paths"), F.col("caught_paths")
    label = F.when(total == 0, "unknown").when(caught == total, "always_caught").when(caught == 0, "never_caught").otherwise("sometimes_caught")
    what = " ".join(x for x in (exception or "an exception", f"from {function}" if function else "") if x)
    by = F.when(F.col("_first.caught_by") != "", F.concat(F.lit(" First by "), F.col("_first.caught_by"), F.lit(" at "), F.col("_first.caught_at"), F.lit("."))).otherwise("")
    text = (
        F.when(total == 0, F.lit(f"No call path leads to {function or 'the function'}."))
        .when(caught == total, F.concat(F.format_string(f"{what} is caught on all %d paths.", total), by))
        .when(caught == 0, F.format_string(f"{what} is caught on none of %d paths.", total))
        .otherwise(F.concat(F.format_string(f"{what} is caught on %d of %d paths.", caught, total), F.coalesce(F.concat(F.lit(" Not on: "), F.col("_open"), F.lit(".")), F.lit(""))))
    )
    return found.select(label.alias("protection"), "total_paths", "caught_paths", text.alias("summary"))


def throw_propagation(paths: DataFrame, call_sites: DataFrame, exception: str = "", more: dict[str, str] | None = None) -> DataFrame:
    """What ``protection`` says, asked from the side of the throw."""
    return protection(paths, call_sites, exception, more)


def nearest_catches(target: str, edges: DataFrame, call_sites: DataFrame, max_depth: int = 20) -> DataFrame:
    """(caller, callee, frames, try_location): going up from the target, the first calls under a try on each branch.

    Breadth first: each (caller, callee) is reported once, with the least frames.
    """
    spark = edges.sparkSession
    pairs = edges.select("caller", "callee").distinct()
    first = first_by(call_sites, "caller_usr", "callee_usr").select("caller_usr", "callee_usr", F.get("try_scopes", 0)["try_location"].alias("try_location"))
    pairs = cut(pairs.join(first, (F.col("caller") == F.col("caller_usr")) & (F.col("callee") == F.col("callee_usr")), "left").select("caller", "callee", "try_location"))
    frontier = spark.createDataFrame([(target,)], "node string")
    seen, found, level = frontier, None, 0
    while level < max_depth:
        level += 1
        up = cut(frontier.join(pairs, F.col("node") == F.col("callee")).select("caller", "callee", "try_location"))
        hit = up.where("try_location is not null").withColumn("frames", F.lit(level))
        found = hit if found is None else found.unionByName(hit)
        frontier = cut(up.where("try_location is null").select(F.col("caller").alias("node")).distinct().join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    best = found.groupBy("caller", "callee").agg(F.min(F.struct("frames", "try_location")).alias("x"))
    return best.select("caller", "callee", "x.frames", "x.try_location")


def locks_on_paths(paths: DataFrame, call_sites: DataFrame) -> DataFrame:
    """(rank, entry, nodes, type_name, var_name, held_at): locks held along each path, each (type, variable) at its hop nearest the target.

    A hop's context is the first at its site for its caller, else the first at the site.
    """
    rows = cut(hops(paths).where("pos is not null"))
    sites = F.broadcast(rows.select("call_site").distinct())
    near = cut(call_sites.join(sites, "call_site", "left_semi"))
    own = first_by(near, "call_site", "caller_usr").select(F.col("call_site").alias("s1"), F.col("caller_usr").alias("u"), F.col("raii_locals").alias("l1"))
    any_ = first_by(near, "call_site").select(F.col("call_site").alias("s2"), F.col("raii_locals").alias("l2"))
    rows = rows.join(own, (F.col("call_site") == F.col("s1")) & (F.col("caller") == F.col("u")), "left").join(any_, F.col("call_site") == F.col("s2"), "left")
    locks = rows.select("rank", "pos", "call_site", F.explode(F.coalesce("l1", "l2")).alias("x")).where("x.kind = 'lock'")
    best = locks.groupBy("rank", "x.type_name", "x.var_name").agg(F.max_by("call_site", "pos").alias("held_at"))
    ends = paths.select("rank", F.get("nodes", 0).alias("entry"), "nodes")
    return best.join(ends, "rank").select("rank", "entry", "nodes", "type_name", "var_name", "held_at")


def same_locks(a: DataFrame, b: DataFrame) -> DataFrame:
    """(type_name, var_name, on_a, on_b) over two results of ``locks_on_paths``: shared ones are on both."""
    left = a.select("type_name", "var_name").distinct().withColumn("on_a", F.lit(True))
    right = b.select("type_name", "var_name").distinct().withColumn("on_b", F.lit(True))
    both = left.join(right, ["type_name", "var_name"], "full_outer")
    return both.select("type_name", "var_name", F.coalesce("on_a", F.lit(False)).alias("on_a"), F.coalesce("on_b", F.lit(False)).alias("on_b"))
