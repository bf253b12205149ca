"""Call-site contexts: lookups, protection, guards and RAII locals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.plans.schema import RAII_KINDS, require

#: What makes "first" a total order among contexts of one key.
_ORDER = ("seq", "callee_usr", "tu_path")


def first_by(call_sites: DataFrame, *keys: str) -> DataFrame:
    """The first context of every key, by order of recording."""
    rest = [c for c in call_sites.columns if c not in keys]
    best = call_sites.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*_ORDER)).alias("_x"))
    return best.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])


def is_call_site(text: Column) -> Column:
    """file:line:column with a file and digits."""
    return text.rlike("^.+:[0-9]+:[0-9]+$")


def at_site(call_sites: DataFrame, site: str, caller: str = "") -> DataFrame:
    """All contexts at a site, or those of one caller (usr or name)."""
    rows = call_sites.where(F.col("call_site") == site)
    return rows.where((F.col("caller_usr") == caller) | (F.col("caller_name") == caller)) if caller else rows


def for_function(call_sites: DataFrame, name: str, side: str = "callee") -> DataFrame:
    """Contexts of a callee or caller: by usr, and only if there is none, by name."""
    by_usr = call_sites.where(F.col(f"{side}_usr") == name)
    hit = by_usr.limit(1).agg(F.count("*").alias("_n"))
    by_name = call_sites.where(F.col(f"{side}_name") == name).crossJoin(F.broadcast(hit)).where("_n = 0").drop("_n")
    return by_usr.unionByName(by_name)


def described(contexts: DataFrame) -> DataFrame:
    """What a context says about a call: protection, guards, termination."""
    return contexts.select(
        "call_site",
        "caller_name",
        "caller_usr",
        "callee_name",
        "callee_usr",
        (F.size("try_scopes") > 0).alias("is_under_try_catch"),
        (F.col("caller_noexcept") == "Noexcept").alias("would_terminate_if_throws"),
        "inside_catch_block",
        F.size("try_scopes").cast("long").alias("try_scope_count"),
        F.size("guards").cast("long").alias("guard_count"),
        "try_scopes",
        "guards",
    )


def query_call_site(call_sites: DataFrame, site: str) -> DataFrame:
    """One row on the first context at a site; a site without any gives an empty record, not an error."""
    wanted = call_sites.sparkSession.createDataFrame([(site,)], "call_site string")
    known = described(first_by(at_site(call_sites, site), "call_site"))
    both = wanted.join(known, "call_site", "left").fillna("").fillna(0).fillna(False)
    empty = lambda c: F.coalesce(c, F.array().cast(dict(known.dtypes)[c])).alias(c)
    return both.select(*[empty(c) if c in ("try_scopes", "guards") else c for c in known.columns])


def ambiguous_sites(call_sites: DataFrame) -> DataFrame:
    """(call_site, contexts) of sites with several contexts: they need a caller to be told apart."""
    return call_sites.groupBy("call_site").agg(F.count("*").alias("contexts")).where("contexts > 1")


def raii_locals(contexts: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Contexts with ``locals``: their RAII locals of the kinds (all if none are given)."""
    for kind in kinds:
        require(kind, RAII_KINDS, "RAII kind")
    kept = F.filter("raii_locals", lambda x: x["kind"].isin(*kinds)) if kinds else F.col("raii_locals")
    return contexts.withColumn("locals", kept)


def protected_calls(call_sites: DataFrame) -> DataFrame:
    return call_sites.where(F.size("try_scopes") > 0)


def unprotected_calls(call_sites: DataFrame) -> DataFrame:
    return call_sites.where(F.size("try_scopes") == 0)


def feature_flags(guards: DataFrame, column: str, patterns: list[tuple[str, int]]) -> DataFrame:
    """Adds ``flag``: the group of the first pattern that is found in the condition, or null.

    A group that the pattern doesn't have means the whole match.
    """
    import re

    found = F.lit(None).cast("string")
    for pattern, group in reversed(patterns):
        g = group if group <= re.compile(pattern).groups else 0
        found = F.when(F.col(column).rlike(pattern), F.regexp_extract(column, pattern, g)).otherwise(found)
    return guards.withColumn("flag", found)


def dump(call_sites: DataFrame) -> DataFrame:
    """One JSON document per context, fields that are at their default left out."""
    unless = lambda c, default: F.when(F.col(c) != default, F.col(c)).alias(c)
    return call_sites.select(
        F.to_json(
            F.struct(
                "caller_name",
                "callee_name",
                "call_site",
                F.when(F.size("try_scopes") > 0, F.col("try_scopes")).alias("try_scopes"),
                F.when(F.size("guards") > 0, F.col("guards")).alias("guards"),
                F.when(F.size("raii_locals") > 0, F.col("raii_locals")).alias("raii_locals"),
                unless("caller_noexcept", "None"),
                F.when(F.col("inside_catch_block"), F.lit(True)).alias("inside_catch_block"),
            )
        ).alias("value")
    )
