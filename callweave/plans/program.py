"""The checks as a program: selected checks over fact tables give one table of diagnostics."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators import checks
from callweave.operators.checks import diagnostic
from callweave.plans.checkset import Registry

Tables = dict[str, DataFrame]



def _odr(t: Tables) -> DataFrame:
    rows = checks.odr(t["odr_entries"])
    decl = F.when(F.col("is_class"), F.col("qualified_name")).otherwise(F.concat("qualified_name", F.lit("("), "signature", F.lit(")")))
    what = F.when(F.col("kind") == "ODR_Divergent", " has several definitions at one place").otherwise(" has different definitions at several places")
    found = rows.select("*", F.concat(decl, what).alias("m"), decl.alias("d"))
    return found.select(F.col("kind"), *diagnostic("", "odr-violations", F.col("site"), F.col("m"), F.col("d"))[1:])


def _default_args(t: Tables) -> DataFrame:
    first = t["default_args"].groupBy("qualified_name", "signature", "param_index").agg(F.min(F.struct("file_path", "line")).alias("x"))
    rows = checks.default_args(t["default_args"]).join(first, ["qualified_name", "signature", "param_index"])
    at = F.concat("x.file_path", F.lit(":"), F.col("x.line").cast("string"))
    text = F.concat(F.lit("default of parameter "), F.col("param_index").cast("string"), F.lit(" of "), "qualified_name", F.lit(" differs: "), "texts")
    return rows.select(*diagnostic("DefaultArg_Divergence", "default-arg-divergence", at, text, F.col("qualified_name")))


def _exception_specs(t: Tables) -> DataFrame:
    rows = checks.exception_specs(t["exception_specs"])
    text = F.concat("qualified_name", F.lit(" is noexcept at one declaration and not at another ("), "kind", F.lit(")"))
    return rows.select(*diagnostic("ExceptionSpec_Divergence", "exception-spec-divergence", F.col("site"), text, F.col("qualified_name")))


def _header_statics(t: Tables) -> DataFrame:
    rows = checks.header_statics(t["header_statics"])
    at = F.concat("file_path", F.lit(":"), F.col("line").cast("string"))
    text = F.concat("name", F.lit(" is a copy of its own in "), F.col("units").cast("string"), F.lit(" units: "), "listed")
    return rows.select(*diagnostic("HeaderStatic_Duplication", "header-static-duplication", at, text, F.col("name")))


def _chain(kind: str, check: str, rows: DataFrame, what: str) -> DataFrame:
    over = F.when(F.col("chain") == "", "").otherwise(F.concat(F.lit(" over "), "chain"))
    return rows.select(*diagnostic(kind, check, F.col("root"), F.concat("root", F.lit(what), "target", over), F.col("root"), F.col("target")))


def _static_init_order(t: Tables) -> DataFrame:
    return _chain("StaticInit_Order", "static-init-order", checks.static_init_order(t["static_inits"], t["fn_summaries"]), " may run before ")


def _exception_escape(t: Tables) -> DataFrame:
    return _chain("Exception_Escape", "exception-escape", checks.exception_escape(t["fn_summaries"]), " is noexcept and reaches a throw in ")


def _adl(t: Tables) -> DataFrame:
    rows = checks.adl(t["adl_calls"], t["overloads"], t["tu_includes"])
    text = F.concat(F.lit("call resolves to "), "resolved_decl", F.lit("; with "), "missing_header", F.lit(" it would be "), "better_decl")
    return rows.withColumn("m", text).select("kind", *diagnostic("", "adl-visibility", F.col("call_location"), F.col("m"), F.col("resolved_decl"), F.col("better_decl"), F.col("missing_header"))[1:])


def _ctad(t: Tables) -> DataFrame:
    text = F.concat("template_name", F.lit(" is deduced as "), "deduced_type", F.lit("; a guide in "), "missing_header", F.lit(" says "), "other")
    return checks.ctad(t["ctad_vars"], t["deduction_guides"], t["tu_includes"]).select(
        *diagnostic("CTAD_Fallback", "ctad-visibility", F.col("call_location"), text, F.col("deduced_type"), F.col("other"), F.col("missing_header"))
    )


def _specializations(t: Tables) -> DataFrame:
    name = F.concat("template_name", F.lit("<"), "args_string", F.lit(">"))
    text = F.concat(name, F.lit(" is instantiated without its specialisation in "), "missing_header")
    return checks.specializations(t["instantiations"], t["specializations"], t["tu_includes"]).select(
        *diagnostic("Specialization_Invisible", "specialization-visibility", F.col("at"), text, name, None, F.col("missing_header"))
    )


def _coverage(t: Tables) -> DataFrame:
    risky = checks.coverage_risky(t["coverage_props"])
    text = F.concat("qualified_name", F.lit(" may vanish from coverage: "), "risk")
    return risky.select(*diagnostic("Coverage_Risky", "coverage-properties", F.col("enclosing_class"), text, F.col("signature")))


#: The programs of the checks by name, with the tables that each needs; dead code runs over the graph, see ``operators.liveness``.
PROGRAMS: dict[str, tuple[Callable[[Tables], DataFrame], tuple[str, ...]]] = {
    "adl-visibility": (_adl, ("adl_calls", "overloads", "tu_includes")),
    "ctad-visibility": (_ctad, ("ctad_vars", "deduction_guides", "tu_includes")),
    "specialization-visibility": (_specializations, ("instantiations", "specializations", "tu_includes")),
    "default-arg-divergence": (_default_args, ("default_args",)),
    "static-init-order": (_static_init_order, ("static_inits", "fn_summaries")),
    "header-static-duplication": (_header_statics, ("header_statics",)),
    "exception-spec-divergence": (_exception_specs, ("exception_specs",)),
    "exception-escape": (_exception_escape, ("fn_summaries",)),
    "odr-violations": (_odr, ("odr_entries",)),
    "coverage-properties": (_coverage, ("coverage_props",)),
}


def run(tables: Tables, names: Iterable[str], registry: Registry | None = None) -> DataFrame | None:
    """Diagnostics of the named checks (as ``resolve_checks`` gives them) whose tables are there, and of an organisation's own.

    In order of place, message and check; None if nothing can run.
    """
    wanted, out = set(names), None
    for name, (program, needs) in PROGRAMS.items():
        if name in wanted and all(n in tables for n in needs):
            found = program(tables)
            out = found if out is None else out.unionByName(found)
    if registry is not None and (own := registry.run(tables)) is not None:
        out = own if out is None else out.unionByName(own)
    return None if out is None else out.orderBy("call_location", "message", "check_name")
