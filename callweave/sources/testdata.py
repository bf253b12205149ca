"""A deterministic reading of the star-schema test tables as code facts.

The facts are SQL that both Spark and DuckDB run (``//`` is written ``div`` for
Spark), so an oracle sees the very rows that a query sees.  Nested columns are kept
flat here (``*_flat``) and nested by :func:`facts`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.plans.schema import conform

_S = "cast({} as string)"
_LI = """select 'o:' || cast(l_orderkey as string) as o, 'p:' || cast(l_partkey as string) as p, 's:' || cast(l_suppkey as string) as s,
  l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_quantity as bigint) as qty, l_returnflag, l_linestatus, l_tax,
  case l_returnflag when 'A' then 'Proven' when 'N' then 'Plausible' else 'Unknown' end as conf,
  'tu' || cast(l_orderkey % 16 as string) as tu from lineitem"""

FACTS: dict[str, str] = {
    "nodes": """
select 'r:' || cast(r_regionkey as string) as usr, r_name as qualified_name, '/usr/include/region.h' as file, cast(r_regionkey as int) as line,
  true as is_entry_point, false as is_virtual, '' as enclosing_class from region
union all select 'n:' || cast(n_nationkey as string), n_name, '/w/src/nation.cpp', cast(n_nationkey as int), false, false, '' from nation
union all select 'c:' || cast(c_custkey as string), c_name, '/w/src/' || c_mktsegment || '/customer.cpp', cast(c_custkey % 1000 as int), false, false, '' from customer
union all select 'o:' || cast(o_orderkey as string), 'Order#' || cast(o_orderkey as string), '/w/src/orders.cpp', cast(o_orderkey % 1000 as int), false, false, '' from orders
union all select 'p:' || cast(p_partkey as string), p_name, '/w/lib/' || p_brand || '.cpp', cast(p_partkey % 1000 as int), false, p_size % 2 = 0, p_type from part
union all select 's:' || cast(s_suppkey as string), s_name, 'src/supplier.cpp', cast(s_suppkey % 1000 as int), false, false, '' from supplier""",
    "edge_tus": f"""
select 'r:' || cast(n_regionkey as string) as caller, 'n:' || cast(n_nationkey as string) as callee, 'region.cpp:' || cast(n_nationkey as string) || ':1' as call_site,
  'DirectCall' as kind, 'Proven' as confidence, 'Synchronous' as exec_context, 0 as indirection_depth, 'tu0' as tu_path from nation
union all select 'n:' || cast(c_nationkey as string), 'c:' || cast(c_custkey as string), 'nation.cpp:' || cast(c_custkey as string) || ':1',
  'DirectCall', 'Proven', 'Synchronous', 0, 'tu0' from customer
union all select 'c:' || cast(o_custkey as string), 'o:' || cast(o_orderkey as string), 'customer.cpp:' || cast(o_orderkey as string) || ':1',
  case o_orderstatus when 'F' then 'DirectCall' when 'O' then 'ThreadEntry' else 'FunctionPointer' end,
  case o_orderstatus when 'F' then 'Proven' when 'O' then 'Plausible' else 'Unknown' end,
  case substr(o_orderpriority, 1, 1) when '1' then 'Synchronous' when '2' then 'ThreadSpawn' when '3' then 'AsyncTask' when '4' then 'PackagedTask' else 'Invoke' end,
  1, 'tu' || cast(o_orderkey % 16 as string) from orders
union all select o, p, 'order.cpp:' || cast(l_orderkey as string) || ':' || cast(l_linenumber as string),
  case when l_linestatus <> 'F' then 'VirtualDispatch' when l_linenumber = 3 then 'ConstructorCall' else 'DirectCall' end, conf, 'Synchronous', 0, tu from ({_LI}) li
union all select p, s, 'part.cpp:' || cast(l_partkey as string) || ':' || cast(l_suppkey as string),
  case when qty = 1 then 'FunctionPointerReturn' when qty < 5 then 'LambdaCall' else 'DirectCall' end, conf,
  case when qty = 1 and l_linenumber % 2 = 0 then 'ThreadSpawn' else 'Synchronous' end, 0, tu from ({_LI}) li
union all select 's:' || cast(s_suppkey as string), 'n:' || cast(s_nationkey as string), 'supplier.cpp:' || cast(s_suppkey as string) || ':1',
  'DirectCall', 'Proven', 'Synchronous', 0, 'tu1' from supplier""",
    "edges": "select caller, callee, call_site, kind, confidence, exec_context, indirection_depth, count(*) as refs from edge_tus group by caller, callee, call_site, kind, confidence, exec_context, indirection_depth",
    "method_overrides": "select 'p:' || cast(p_partkey // 2 as string) as base_method, 'p:' || cast(p_partkey as string) as override_method from part where p_partkey // 2 > 0",
    "derived_classes": "select distinct p_type as base, p_type || '/' || p_brand as derived from part union select distinct p_type || '/' || p_brand, p_name from part where p_size < 10",
    "effective_impls": "select distinct 'p:' || cast(p_partkey as string) as impl_method, p_type || '/' || p_brand as concrete_class from part",
    "function_returns": f"select distinct s as func, p as returned_func from ({_LI}) li where qty = 50",
    "call_sites_flat": f"""
select cast(l_orderkey as bigint) * 8 + l_linenumber as seq, 'Order#' || cast(l_orderkey as string) as caller_name, o as caller_usr, p as callee_usr,
  coalesce(p_name, '') as callee_name, 'order.cpp:' || cast(l_orderkey as string) || ':' || cast(l_linenumber as string) as call_site, tu as tu_path,
  l_tax >= 0.05 as has_scope, 'order.cpp:' || cast(l_orderkey as string) || ':0' as try_location,
  case l_linenumber % 4 when 0 then '...' when 1 then 'std::exception' when 2 then 'std::runtime_error' else 'std::logic_error' end as caught_type,
  l_linenumber % 4 = 0 as is_catch_all, 'FFlag::' || coalesce(p_brand, '') as condition_text, l_returnflag = 'A' as in_true_branch,
  case when qty % 7 = 0 then 'Noexcept' else 'None' end as caller_noexcept,
  coalesce(p_type, '') as type_name, coalesce(p_brand, '') as var_name,
  case coalesce(p_size, 0) % 3 when 0 then 'lock' when 1 then 'smart_ptr' else 'other' end as raii_kind
from ({_LI}) li left join part on p_partkey = l_partkey""",
    "channel_site_tus": """
select 'ch' || cast(user_id % 20 as string) as channel_id, 'Queue<' || cast(user_id % 3 as string) || '>' as channel_type,
  case user_id % 2 when 0 then 'queue' else 'signal' end as category,
  case when event_type in ('click', 'purchase') then 'produce' else 'consume' end as op,
  'o:' || cast(event_id % 97 as string) as function_usr, 'Order#' || cast(event_id % 97 as string) as function_display,
  'ev.cpp:' || cast(event_id % 500 as string) || ':1' as call_site, 'tu' || cast(event_id % 16 as string) as tu_path
from events where event_type in ('click', 'purchase', 'view')""",
    "odr_entries": """
select distinct coalesce(source, '') as qualified_name, coalesce(lang, '') as signature, doc_id % 3 = 0 as is_class, case when doc_id % 3 = 0 then '' else coalesce(source, '') end as enclosing_class,
  'inc/f' || cast(doc_id % 50 as string) || '.h' as file_path, cast(doc_id % 50 as int) as line, substr(md5(coalesce(text, '')), 1, 2) as odr_hash from documents""",
    "default_args": """
select distinct coalesce(source, '') as qualified_name, coalesce(lang, '') as signature, cast(doc_id % 3 as int) as param_index,
  cast((n_chars // 1000) % 3 as string) as default_text, 'inc/d' || cast(doc_id % 7 as string) || '.h' as file_path, cast(doc_id % 11 as int) as line
from documents""",
    "exception_specs": """
select distinct 'c' || cast(o_custkey % 200 as string) as qualified_name, o_orderpriority as signature, o_orderstatus = 'F' as is_noexcept,
  'inc/e' || cast(o_orderkey % 13 as string) || '.h' as file_path, cast(o_orderkey % 5 as int) as line from orders""",
    "header_statics_flat": """
select distinct 'g' || cast(o_custkey as string) as name, 'inc/h' || cast(o_custkey % 40 as string) || '.h' as file_path, cast(o_custkey as int) as line,
  o_custkey % 3 = 0 as is_const, 'tu' || cast(o_orderkey % 16 as string) as tu_path from orders""",
    "coverage_props": """
select p_brand as enclosing_class, p_name as qualified_name, 'p:' || cast(p_partkey as string) as signature, 'lib/' || p_brand || '.h' as header_path,
  cast(p_partkey % 1000 as int) as source_line, cast(p_size % 5 as int) as gva_linkage, cast(p_size as int) as body_stmt_count, p_size < 3 as is_trivial from part""",
    "fn_flat": """
select 'p:' || cast(p_partkey as string) as qualified_name, 'lib/' || p_brand || '.cpp' as file_path, cast(p_partkey as int) as line,
  p_size % 7 = 0 as is_noexcept, p_size = 50 as has_uncaught_throw, p_partkey % 10 = 0 as dynamic_init, p_partkey % 4 = 0 as is_constructor_fn from part""",
    "fn_calls": "select 'p:' || cast(p_partkey // 2 as string) as caller, 'p:' || cast(p_partkey as string) as callee, p_partkey % 3 <> 0 as unguarded from part where p_partkey // 2 > 0",
    "fn_globals": "select 'p:' || cast(p_partkey as string) as func, 'p:' || cast((p_partkey * 7) % 2000 as string) as global from part",
    "overloads_flat": """
select p_name as qualified_name, 'inc/' || p_brand || '.h' as header_path, cast(p_partkey as bigint) as seq, cast(p_partkey % 1000 as int) as source_line,
  case p_size % 4 when 0 then 'Vector' when 1 then 'Matrix' when 2 then 'const Vector &' else 'Vector' end as t0,
  case p_size % 6 when 0 then 'int' when 1 then 'double' when 2 then 'float' when 3 then 'Mile' when 4 then 'unsigned int' else 'long' end as t1 from part""",
    "adl_flat": f"""
select tu as tu_path, 'order.cpp:' || cast(l_orderkey as string) || ':' || cast(l_linenumber as string) as call_location, p_name as qualified_name,
  case p_size % 4 when 0 then 'Vector' when 1 then 'Matrix' when 2 then 'const Vector &' else 'Vector' end as r0,
  case p_size % 6 when 0 then 'int' when 1 then 'double' when 2 then 'float' when 3 then 'Mile' when 4 then 'unsigned int' else 'long' end as r1,
  'Vector' as a0, case l_linenumber % 3 when 0 then 'int' when 1 then 'double' else 'long' end as a1
from ({_LI}) li join part on p_partkey = l_partkey""",
    "tu_includes": "select distinct 'tu' || cast(p_partkey % 16 as string) as tu_path, 'inc/' || p_brand || '.h' as file from part where p_size % 2 = 0",
    "deduction_guides": "select p_type as template_name, 'inc/' || p_brand || '.h' as header_path, 'D' || cast(p_size % 3 as string) as deduced_type from part",
    "ctad_vars": f"select tu as tu_path, 'ctad.cpp:' || cast(l_orderkey as string) || ':' || cast(l_linenumber as string) as call_location, p_type as template_name, 'D' || cast(l_linenumber % 3 as string) as deduced_type from ({_LI}) li join part on p_partkey = l_partkey",
    "specializations": "select distinct p_type as template_name, p_brand as args_string, 'inc/' || p_brand || '.h' as header_path from part",
    "instantiations": f"select tu as tu_path, p_type as template_name, p_brand as args_string, 'inst.cpp:' || cast(l_orderkey as string) || ':' || cast(l_linenumber as string) as point_of_instantiation from ({_LI}) li join part on p_partkey = l_partkey",
    "type_bases": "select distinct p_type || '/' || p_brand as derived, p_type as base from part union select distinct p_type, split_part(p_type, ' ', 1) from part",
    "type_ctor_edges": "select distinct p_brand as to_type, p_type as from_type from part where p_size = 7",
    "type_conv_edges": "select distinct p_type as from_type, p_brand as to_type from part where p_size = 9",
    "stamps_old": "select 'f' || cast(o_orderkey as string) as path, cast(o_custkey as bigint) as mtime_ns, cast(o_orderkey % 100 as bigint) as size from orders where o_orderkey % 5 <> 0",
    "stamps_new": "select 'f' || cast(o_orderkey as string) as path, cast(case when o_orderkey % 7 = 0 then o_custkey + 1 else o_custkey end as bigint) as mtime_ns, cast(o_orderkey % 100 as bigint) as size from orders where o_orderkey % 6 <> 0",
    "journal": "select cast(event_id as bigint) as seq, 'tu' || cast(user_id as string) as tu_path, cast(user_id % 3 as bigint) as stamp, event_type as state from events where event_type in ('click', 'view', 'purchase')",
    "node_tus": """
select distinct 'o:' || cast(o_orderkey as string) as usr, 'tu' || cast(o_orderkey % 16 as string) as tu_path from orders
union select distinct p, tu from (select 'p:' || cast(l_partkey as string) as p, 'tu' || cast(l_orderkey % 16 as string) as tu from lineitem) li""",
    "rewrites": "select 'd' || cast(p_partkey as string) as file, cast(p_partkey as int) as place, p_name as a, p_brand as b, p_size % 3 = 0 as is_macro_arg, case p_size % 2 when 0 then 'CHECK' else 'LOG' end as macro_name, p_size % 5 = 0 as is_whole_arg from part",
    "texts": "select 'd' || cast(doc_id as string) as file, coalesce(text, '') as text from documents",
    "build_stats": "select 'tu' || cast(event_id % 200 as string) as file, event_type as phase, cast(event_id % 1000 as bigint) as ms, cast(case user_id % 9 when 0 then 1 when 1 then 2 when 2 then -1 else 0 end as int) as tool_status from events",
}

#: What each fact reads.
_NEEDS = {"edges": ("edge_tus",)}
_INPUTS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def oracle(*names: str) -> str:
    """``with`` clause for DuckDB that defines the named facts."""
    order: list[str] = []
    for name in names:
        order += [n for n in (*_NEEDS.get(name, ()), name) if n not in order]
    return "with recursive " + ",\n".join(f"{n} as ({FACTS[n]})" for n in order)


def fact(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fact table."""
    views = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _INPUTS if f" {t}" in FACTS[name]}
    views |= {n: fact(spark, sf_dir, n) for n in _NEEDS.get(name, ())}
    sql = FACTS[name].replace("//", "div")
    for view in views:  # a placeholder only where the name is a table
        sql = sql.replace(f"from {view}", f"from {{{view}}}").replace(f"join {view} ", f"join {{{view}}} ")
    return spark.sql(sql, **views)


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R9 with its nested columns."""
    flat = fact(spark, sf_dir, "call_sites_flat")
    handler = F.struct("caught_type", "is_catch_all", F.col("try_location").alias("location"), F.lit("").alias("body_summary"))
    scope = F.struct("try_location", F.col("caller_name").alias("enclosing_function"), F.lit(0).alias("nesting_depth"), F.array(handler).alias("handlers"))
    guard = F.struct("condition_text", F.col("call_site").alias("location"), "in_true_branch", F.lit(False).alias("is_assertion"))
    local = F.struct("type_name", "var_name", F.col("call_site").alias("decl_location"), F.col("raii_kind").alias("kind"))
    nested = flat.withColumns({"try_scopes": F.when(F.col("has_scope"), F.array(scope)), "guards": F.array(guard), "raii_locals": F.array(local)})
    return conform(nested, "call_sites")
