"""Column types and enumerations of the fact tables (the engine's input boundary)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Spellings of the enumerations.
EDGE_KINDS = (
    "DirectCall",
    "VirtualDispatch",
    "FunctionPointer",
    "ConstructorCall",
    "DestructorCall",
    "OperatorCall",
    "TemplateInstantiation",
    "LambdaCall",
    "ThreadEntry",
    "FunctionPointerReturn",
)
CONFIDENCES = ("Unknown", "Plausible", "Proven")  # in order of rank
EXEC_CONTEXTS = ("Synchronous", "ThreadSpawn", "AsyncTask", "PackagedTask", "Invoke")
RAII_KINDS = ("lock", "smart_ptr", "other")
#: Kinds that a query result shows; the last one is always expanded away.
RESULT_KINDS = EDGE_KINDS[:-1]

_HANDLER = "struct<caught_type:string,is_catch_all:boolean,location:string,body_summary:string>"
_SCOPES = f"array<struct<try_location:string,enclosing_function:string,nesting_depth:int,handlers:array<{_HANDLER}>>>"
_GUARDS = "array<struct<condition_text:string,location:string,in_true_branch:boolean,is_assertion:boolean>>"
_RAII = "array<struct<type_name:string,var_name:string,decl_location:string,kind:string>>"
_EDGE = "caller string, callee string, call_site string, kind string, confidence string, exec_context string, indirection_depth int"
_CHANNEL = f"channel_id string, channel_type string, category string, op string, function_usr string, function_display string, call_site string, guards {_GUARDS}"

TABLES: dict[str, str] = {
    "nodes": "usr string, qualified_name string, file string, line int, is_entry_point boolean, is_virtual boolean, enclosing_class string",
    "node_tus": "usr string, tu_path string",
    "edges": f"{_EDGE}, refs long",
    "edge_tus": f"{_EDGE}, tu_path string",
    "derived_classes": "base string, derived string",
    "method_overrides": "base_method string, override_method string",
    "effective_impls": "impl_method string, concrete_class string",
    "function_returns": "func string, returned_func string",
    "call_sites": "seq long, caller_name string, callee_name string, caller_usr string, callee_usr string, call_site string, tu_path string,"
    f" try_scopes {_SCOPES}, guards {_GUARDS}, caller_noexcept string, inside_catch_block boolean, raii_locals {_RAII}",
    "channel_sites": f"{_CHANNEL}, refs long",
    "channel_site_tus": f"{_CHANNEL}, tu_path string",
    "overloads": "seq long, qualified_name string, header_path string, param_types array<string>, return_type string, source_line int",
    "deduction_guides": "template_name string, header_path string, param_types array<string>, deduced_type string, source_line int",
    "coverage_props": "qualified_name string, header_path string, source_line int, enclosing_class string, gva_linkage int, is_inlined boolean,"
    " is_constexpr boolean, is_trivial boolean, body_stmt_count int, signature string",
    "type_bases": "derived string, base string",
    "type_ctor_edges": "to_type string, from_type string",
    "type_conv_edges": "from_type string, to_type string",
    "odr_entries": "qualified_name string, signature string, is_class boolean, enclosing_class string, file_path string, line int, odr_hash string",
    "specializations": "template_name string, args_string string, header_path string, line int",
    "default_args": "qualified_name string, signature string, param_index int, param_name string, default_text string, file_path string, line int",
    "static_inits": "seq long, qualified_name string, file_path string, line int, dynamic_init boolean, is_constructor_fn boolean,"
    " referenced_globals array<string>, called_functions array<string>",
    "fn_summaries": "qualified_name string, file_path string, line int, is_noexcept boolean, has_uncaught_throw boolean,"
    " called_functions array<string>, unguarded_calls array<string>, referenced_globals array<string>",
    "header_statics": "name string, file_path string, line int, is_const boolean, tu_paths array<string>",
    "exception_specs": "qualified_name string, signature string, is_noexcept boolean, file_path string, line int",
    "tu_includes": "tu_path string, file string",
    "adl_calls": "tu_path string, call_location string, qualified_name string, resolved_param_types array<string>, arg_types array<string>",
    "ctad_vars": "tu_path string, call_location string, template_name string, deduced_type string",
    "instantiations": "tu_path string, template_name string, args_string string, point_of_instantiation string",
    "file_stamps": "path string, mtime_ns long, size long",
    "replacements": "file string, offset int, length int, text string",
    "build_stats": "file string, phase string, ms double, tool_status int",
    "compile_commands": "directory string, file string, arguments string",
}

#: What a missing column is filled with: the engine has no nulls.
_DEFAULTS = {
    "confidence": "Proven",
    "exec_context": "Synchronous",
    "kind": "DirectCall",
    "indirection_depth": 0,
    "refs": 1,
    "line": 0,
    "gva_linkage": -1,
}


def struct(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with exactly the columns of ``table``: missing ones filled, nulls replaced, order and types as declared."""
    out = []
    for field in struct(table):
        kind = field.dataType.simpleString()
        empty = _DEFAULTS.get(field.name, {"string": "", "boolean": False, "int": 0, "bigint": 0, "double": 0.0}.get(kind))
        fill = (F.array() if kind.startswith("array") else F.lit(empty)).cast(field.dataType)
        out.append((F.coalesce(F.col(field.name).cast(field.dataType), fill) if field.name in df.columns else fill).alias(field.name))
    return df.select(*out)


def rows(spark: SparkSession, table: str, values: list[dict]) -> DataFrame:
    """A fact table from literal rows; missing keys take the table's defaults."""
    names = [f.name for f in struct(table)]
    return conform(spark.createDataFrame([tuple(v.get(n) for n in names) for v in values], struct(table)), table)


def require(value: str, allowed: tuple[str, ...], what: str) -> str:
    if value not in allowed:
        raise ValueError(f"unknown {what}: {value!r}; one of {', '.join(allowed)}")
    return value


def rank(confidence) -> Column:
    """Unknown 0, Plausible 1, Proven 2."""
    return F.when(confidence == "Proven", 2).when(confidence == "Plausible", 1).otherwise(0)
