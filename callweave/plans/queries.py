"""The code-graph queries over the test tables, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions import scalars
from callweave.operators import channels, checks, contexts, edges, fixpoint, identity, liveness, merge, paths, rewrite, summary
from callweave.sources.testdata import call_sites, fact, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: What was derived once for a session and folder of inputs.
_SAVED: dict[tuple[str, str, str], DataFrame | edges.View] = {}


class Facts:
    """A reader of the facts over one folder; the parts of the view that queries ask for are written once a session."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name == "call_sites":
            return call_sites(self.spark, self.sf_dir)
        if name == "edges":
            return edges.stored(fact(self.spark, self.sf_dir, "edge_tus"))
        return fact(self.spark, self.sf_dir, name)

    @property
    def view(self) -> edges.View:
        """The expanded view in parts."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, "view")
        if key not in _SAVED:
            _SAVED[key] = edges.View(self("edge_tus"), self("method_overrides"), self("function_returns"))
        return _SAVED[key]


def query(*facts: str, sql: str = "") -> Callable:
    """Register a function of a fact reader; ``sql`` is the oracle over the named facts."""

    def add(f: Callable[[Facts], DataFrame]) -> Callable[[Facts], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Facts(spark, sf_dir))

        QUERIES[f.__name__] = run
        run.__doc__ = f.__doc__
        if sql:
            head = oracle(*facts) if facts else ""
            ORACLES[f.__name__] = f"{head}{sql}" if sql.lstrip().startswith(",") else f"{head}\n{sql}"
        return f

    return add


_OVER = """,
over_ as (select base_method as b, override_method as d from method_overrides where base_method <> override_method
  union select o.b, m.override_method from over_ o join method_overrides m on o.d = m.base_method)"""
_ESTAR = f"""{_OVER},
real_ as (select distinct caller, callee, call_site from edges where kind <> 'FunctionPointerReturn'),
syn as (
  select e.caller, o.d as callee, call_site, kind, confidence, exec_context, indirection_depth, 0 as b from edges e join over_ o on e.callee = o.b
  where kind = 'VirtualDispatch' and confidence = 'Plausible'
  union all select e.caller, f.returned_func, call_site, case when exec_context <> 'Synchronous' then 'ThreadEntry' else 'FunctionPointer' end,
    confidence, exec_context, indirection_depth, 1 from edges e join function_returns f on e.callee = f.func where kind = 'FunctionPointerReturn'),
best as (select s.*, row_number() over (partition by caller, callee, call_site order by b, kind, confidence, exec_context, indirection_depth) as rn
  from syn s anti join real_ using (caller, callee, call_site)),
estar as (select caller, callee, call_site, kind, confidence, exec_context, indirection_depth from edges where kind <> 'FunctionPointerReturn'
  union all select caller, callee, call_site, kind, confidence, exec_context, indirection_depth from best where rn = 1)
"""
_GRAPH = ("nodes", "edges", "method_overrides", "function_returns")
_EDGE = "caller, callee, call_site, kind, confidence, exec_context, indirection_depth"


_SURE = edges.EdgeFilter(min_confidence="Proven")


# Edges and lookups


@query(*_GRAPH, sql=f"{_ESTAR} select {_EDGE} from estar where caller = 'p:3'")
def get_callees(read: Facts) -> DataFrame:
    return edges.callees(read("edges"), read("method_overrides"), read("function_returns"), "p:3")


@query(*_GRAPH, sql=f"{_ESTAR} select {_EDGE} from estar where callee = 'p:77' and confidence in ('Plausible', 'Proven')")
def get_callers(read: Facts) -> DataFrame:
    return edges.callers(read("edges"), read("method_overrides"), read("function_returns"), "p:77", edges.EdgeFilter(min_confidence="Plausible"))


@query(*_GRAPH, sql=f"{_ESTAR} select kind, confidence, exec_context, count(*) as n, cast(sum(length(callee)) as bigint) as chars from estar group by all")
def expanded_edges(read: Facts) -> DataFrame:
    """The whole expanded view, by class of edge."""
    return read.view.counts("kind", "confidence", "exec_context")


@query("edge_tus", sql=f"select {_EDGE}, count(*) as refs from edge_tus group by all having count(*) > 1")
def edge_refs(read: Facts) -> DataFrame:
    return edges.stored(read("edge_tus")).where("refs > 1")


@query(*_GRAPH, sql=f"{_ESTAR} select {_EDGE} from estar where kind = 'ThreadEntry' and exec_context = 'ThreadSpawn'")
def concurrency_entry_points(read: Facts) -> DataFrame:
    starts = read.view.narrow(edges.EdgeFilter(("ThreadEntry",), execution_contexts=("ThreadSpawn",)))
    return summary.concurrency_entry_points(starts, ("ThreadSpawn",)).distinct()


@query(*_GRAPH, sql=f"{_ESTAR}, f as (select {_EDGE} from best where rn = 1 and b = 1) select * from f")
def deferred_return_edges(read: Facts) -> DataFrame:
    return read.view.deferred


@query("edges", sql="select callee, count(*) as in_degree from edges group by callee having count(*) > 500")
def stored_in_degree(read: Facts) -> DataFrame:
    return edges.hubs(read("edges"), 500)


@query(
    "nodes",
    "edges",
    sql="""select e.caller, e.callee, count(*) as n from edges e left join nodes a on a.usr = e.caller left join nodes b on b.usr = e.callee
where not (coalesce(contains(a.file, '/src/'), false) and coalesce(contains(b.file, '/src/'), false)) group by all""",
)
def collapse_filter(read: Facts) -> DataFrame:
    return edges.collapsed(read("edges"), read("nodes"), ["src"]).groupBy("caller", "callee").agg(F.count("*").alias("n"))


@query("nodes", sql="select usr from nodes where starts_with(file, '/usr/include/')")
def system_paths(read: Facts) -> DataFrame:
    return read("nodes").where(edges.is_system_path(F.col("file"))).select("usr")


@query("nodes", sql="select usr, qualified_name, file, line, is_entry_point, is_virtual, enclosing_class from nodes where usr = 'p:17'")
def lookup_function(read: Facts) -> DataFrame:
    return identity.find_node(read("nodes"), read("edges"), "p:17")


@query(
    "nodes",
    sql="""select usr, qualified_name, file, line, is_entry_point, is_virtual, enclosing_class,
 cast(case when l = 'order#1' then 0 when starts_with(l, 'order#1') then 1 else 2 end as integer) as tier, count(*) over () as total_matches
from (select *, split_part(lower(qualified_name), '::', -1) as l from nodes where contains(lower(qualified_name), 'order#1'))
order by tier, length(qualified_name), qualified_name, usr limit 25""",
)
def search_functions(read: Facts) -> DataFrame:
    return identity.search(read("nodes"), "Order#1")


# Contexts

_SITE = "call_site, caller_usr, callee_usr"


@query("call_sites_flat", sql=f"select {_SITE}, has_scope as is_under_try_catch, caller_noexcept = 'Noexcept' as would_terminate_if_throws, cast(has_scope as bigint) as try_scope_count, cast(1 as bigint) as guard_count from call_sites_flat where caller_usr = 'o:7'")
def call_site_context(read: Facts) -> DataFrame:
    rows = contexts.described(contexts.for_function(read("call_sites"), "o:7", "caller"))
    return rows.select("call_site", "caller_usr", "callee_usr", "is_under_try_catch", "would_terminate_if_throws", "try_scope_count", "guard_count")


@query("call_sites_flat", sql="select call_site, count(*) as contexts from call_sites_flat group by call_site having count(*) > 1")
def site_disambiguation(read: Facts) -> DataFrame:
    return contexts.ambiguous_sites(read("call_sites"))


@query("call_sites_flat", sql="select call_site, caller_usr, type_name, var_name from call_sites_flat where raii_kind = 'lock' and callee_usr = 'p:38'")
def raii_scopes(read: Facts) -> DataFrame:
    rows = contexts.raii_locals(contexts.for_function(read("call_sites"), "p:38"), ("lock",))
    return rows.select("call_site", "caller_usr", F.explode("locals").alias("x")).select("call_site", "caller_usr", "x.type_name", "x.var_name")


@query("call_sites_flat", sql="select callee_usr, count(*) as n from call_sites_flat where has_scope group by callee_usr")
def protected_calls(read: Facts) -> DataFrame:
    return contexts.protected_calls(read("call_sites")).groupBy("callee_usr").agg(F.count("*").alias("n"))


@query("call_sites_flat", sql="select callee_usr, count(*) as n from call_sites_flat where not has_scope group by callee_usr")
def unprotected_calls(read: Facts) -> DataFrame:
    return contexts.unprotected_calls(read("call_sites")).groupBy("callee_usr").agg(F.count("*").alias("n"))


@query("call_sites_flat", sql="select regexp_extract(condition_text, 'FFlag::(.*)', 1) as flag, in_true_branch, count(*) as n from call_sites_flat group by all")
def feature_flag_guards(read: Facts) -> DataFrame:
    guards = read("call_sites").select(F.explode("guards").alias("g")).select("g.*")
    found = contexts.feature_flags(guards, "condition_text", [("DFFlag::(.*)", 1), ("FFlag::(.*)", 1)])
    return found.groupBy("flag", "in_true_branch").agg(F.count("*").alias("n"))


# Graph

_CLOSURE = "select b as base_method, d as override_method from over_"


@query("method_overrides", sql=f"{_OVER} {_CLOSURE}")
def override_closure(read: Facts) -> DataFrame:
    return edges.override_closure(read("method_overrides"))


@query("method_overrides", sql=f"{_OVER} select b as base_method from over_ where d = 'p:1900'")
def overridden_bases(read: Facts) -> DataFrame:
    return edges.override_closure(read("method_overrides")).where("override_method = 'p:1900'").select("base_method")


@query(
    "derived_classes",
    sql=""",
up as (select base, derived from derived_classes union select u.base, d.derived from up u join derived_classes d on u.derived = d.base)
select base, derived from up where base <> derived""",
)
def class_hierarchy(read: Facts) -> DataFrame:
    return summary.derived_classes(read("derived_classes"), transitive=True)


@query("nodes", "method_overrides", sql="select m.base_method, m.override_method from method_overrides m join nodes n on n.usr = m.base_method where n.is_virtual and n.enclosing_class = (select max(enclosing_class) from nodes)")
def class_overrides(read: Facts) -> DataFrame:
    name = read("nodes").agg(F.max("enclosing_class")).first()[0]
    return summary.virtual_overrides(read("nodes"), read("method_overrides"), name)


@query(
    "edges",
    sql=""",
walk as (select 'r:0' as node, 0 as dist union select e.callee, w.dist + 1 from walk w join edges e on e.caller = w.node where e.confidence = 'Proven' and w.dist < 8)
select node, min(dist) as dist from walk group by node""",
)
def reach_min_dist(read: Facts) -> DataFrame:
    proven = _SURE.apply(read("edge_tus")).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    starts = proven.sparkSession.createDataFrame([("r:0",)], "node string")
    return fixpoint.min_dist(starts, proven, 8)


_PROVEN = f"{_ESTAR}, pe as (select {_EDGE} from estar where confidence = 'Proven')"
_PATHS = """,
back as (select 'p:45' as head, ['p:45'] as nodes, [] :: varchar[] as sites, 0 as length
  union all select e.caller, list_prepend(e.caller, b.nodes), list_prepend(e.call_site, b.sites), b.length + 1
  from back b join pe e on e.callee = b.head where b.length < 4 and not list_contains(b.nodes, e.caller) and not starts_with(b.head, 'r:'))
"""


def _chains(read: Facts, max_paths: int) -> DataFrame:
    view = read.view.narrow(_SURE)
    starts = read("nodes").where("is_entry_point").select(F.col("usr").alias("node"))
    return paths.find_paths(starts, "p:45", view, max_depth=4, max_paths=max_paths)


@query(
    *_GRAPH,
    sql=f"""{_PROVEN}{_PATHS} select cast(length as integer) as length, array_to_string(nodes, ' > ') as path, array_to_string(sites, ' ') as sites from back
where starts_with(head, 'r:') order by length, nodes, sites limit 50""",
)
def find_call_chain(read: Facts) -> DataFrame:
    found = _chains(read, 50)
    sites = F.array_join(F.transform("hops", lambda h: h["call_site"]), " ")
    return found.select("length", F.array_join("nodes", " > ").alias("path"), sites.alias("sites"))


_ALIVE = """,
seen as (select usr as node from nodes where is_entry_point union select e.callee from seen s join estar e on e.caller = s.node where e.confidence = 'Proven')
"""


@query(*_GRAPH, sql=f"{_ESTAR}{_ALIVE} select qualified_name, min(file) as file from nodes left join seen on usr = node group by qualified_name having count(node) = 0")
def dead_code_pessimistic(read: Facts) -> DataFrame:
    nodes = read("nodes")
    sure = liveness.alive(nodes.where("is_entry_point").select(F.col("usr").alias("node")), read.view.narrow(_SURE))
    rated = nodes.join(sure.withColumn("_a", F.lit(1)), F.col("usr") == F.col("node"), "left")
    best = rated.groupBy("qualified_name").agg(F.max("_a").alias("_m"), F.min("file").alias("file"))
    return best.where("_m is null").select("qualified_name", "file")


# Summaries


@query(*_GRAPH, sql=f"{_ESTAR} select c.confidence, count(e.caller) as n from (values ('Unknown'), ('Plausible'), ('Proven')) c(confidence) left join estar e using (confidence) group by all")
def graph_summary_conf(read: Facts) -> DataFrame:
    return summary.filled(read.view.counts("confidence").drop("chars"), "confidence")


_KINDS = ", ".join(f"('{k}')" for k in summary.RESULT_KINDS)


@query(*_GRAPH, sql=f"{_ESTAR} select c.kind, count(e.caller) as n from (values {_KINDS}) c(kind) left join estar e using (kind) group by all")
def graph_summary_kind(read: Facts) -> DataFrame:
    return summary.filled(read.view.counts("kind").drop("chars"), "kind")


def _top_sql(side: str) -> str:
    return f"{_ESTAR} select coalesce(qualified_name, {side}) as name, cast(count(*) as bigint) as n from estar left join nodes on usr = {side} group by 1 order by n desc, name limit 5"


@query(*_GRAPH, sql=_top_sql("caller"))
def top_fanout_callers(read: Facts) -> DataFrame:
    return summary.first(read.view.counts("caller"), read("nodes"), "caller")


@query(*_GRAPH, sql=_top_sql("callee"))
def top_fanin_callees(read: Facts) -> DataFrame:
    return summary.first(read.view.counts("callee"), read("nodes"), "callee")


@query(*_GRAPH, "call_sites_flat", sql=f"{_ESTAR} select (select count(*) from nodes) as node_count, (select count(*) from nodes where is_entry_point) as entry_point_count, (select count(*) from estar where caller in (select usr from nodes)) as edge_count, (select count(*) from call_sites_flat) as call_site_count")
def graph_summary(read: Facts) -> DataFrame:
    return summary.sizes(read("nodes"), read.view.counts("caller"), read("call_sites"))


# Channels

_CH = "select channel_id, channel_type, category, op, function_usr, function_display, call_site, count(*) as refs from channel_site_tus group by all"


@query("channel_site_tus", sql=f", c as ({_CH}) select channel_id, min(channel_type) as channel_type, min(category) as category, count(*) filter (op = 'produce') as producers, count(*) filter (op = 'consume') as consumers from c group by channel_id")
def list_channels(read: Facts) -> DataFrame:
    return channels.channels(channels.counted(read("channel_site_tus")))


@query("channel_site_tus", sql=f", c as ({_CH}) select * from c where channel_id = 'ch3'")
def query_channel(read: Facts) -> DataFrame:
    return channels.channel(channels.counted(read("channel_site_tus")), "ch3")


@query("channel_site_tus", sql=f", c as ({_CH}) select * from c where function_usr = 'o:5' or function_display = 'o:5'")
def channel_sites(read: Facts) -> DataFrame:
    return channels.for_function(channels.counted(read("channel_site_tus")), "o:5")


# Checks

_ODR = """,
s as (select qualified_name, signature, is_class, file_path, line, count(distinct odr_hash) as n from odr_entries group by all),
g as (select qualified_name, signature, is_class, count(*) as sites, min(case when n > 1 then file_path || chr(0) || lpad(cast(line as string), 9, '0') || chr(0) || cast(line as string) end) as split,
  min(file_path || chr(0) || lpad(cast(line as string), 9, '0') || chr(0) || cast(line as string)) as first from s group by all),
h as (select qualified_name, signature, is_class, count(distinct odr_hash) as hashes, max(enclosing_class) as class from odr_entries group by all),
k as (select g.*, h.class, case when split is not null then 'ODR_Divergent' when sites > 1 and hashes > 1 then 'ODR_Duplicate' end as kind,
  coalesce(split, first) as loc from g join h using (qualified_name, signature, is_class))
select qualified_name, signature, is_class, kind, split_part(loc, chr(0), 1) || ':' || split_part(loc, chr(0), 3) as site from k
where kind is not null and not (not is_class and class in (select qualified_name from k where is_class and kind = 'ODR_Duplicate'))"""


@query("odr_entries", sql=_ODR)
def odr_violations(read: Facts) -> DataFrame:
    return checks.odr(read("odr_entries"))


@query("default_args", sql="select qualified_name, signature, param_index, string_agg(distinct default_text, ' | ' order by default_text) as texts from default_args group by all having count(distinct default_text) > 1")
def default_arg_divergence(read: Facts) -> DataFrame:
    return checks.default_args(read("default_args"))


@query(
    "exception_specs",
    sql=""",
s as (select qualified_name, signature, file_path, line, bool_or(is_noexcept) as a, bool_and(is_noexcept) as b,
  file_path || chr(0) || lpad(cast(line as string), 9, '0') || chr(0) || cast(line as string) as k from exception_specs group by qualified_name, signature, file_path, line),
g as (select qualified_name, signature, min(case when a and not b then k end) as both_, min(k) as first from s group by 1, 2 having bool_or(a) and not bool_and(b))
select qualified_name, signature, case when both_ is not null then 'SameSite' else 'CrossSite' end as kind,
  split_part(coalesce(both_, first), chr(0), 1) || ':' || split_part(coalesce(both_, first), chr(0), 3) as site from g""",
)
def exception_spec_divergence(read: Facts) -> DataFrame:
    return checks.exception_specs(read("exception_specs"))


@query(
    "header_statics_flat",
    sql=""",
g as (select file_path, line, min(name) as name, min_by(is_const, (name, is_const)) as is_const, list_sort(list_distinct(list(tu_path))) as tus from header_statics_flat group by file_path, line)
select name, file_path, line, len(tus) as units, array_to_string(tus[1:3], ', ') || case when len(tus) > 3 then ', ...' else '' end as listed from g where not is_const and len(tus) > 1""",
)
def header_static_duplication(read: Facts) -> DataFrame:
    flat = read("header_statics_flat")
    return checks.header_statics(flat.groupBy("name", "file_path", "line", "is_const").agg(F.collect_set("tu_path").alias("tu_paths")))


@query("coverage_props", sql="select enclosing_class, qualified_name, signature, case gva_linkage when 2 then 'DiscardableODR' else 'AvailableExternally' end as risk from coverage_props where gva_linkage in (1, 2)")
def coverage_risky(read: Facts) -> DataFrame:
    return checks.coverage_risky(read("coverage_props"))


_GVA = "case {} when 0 then 'GVA_Internal' when 1 then 'GVA_AvailableExternally' when 2 then 'GVA_DiscardableODR' when 3 then 'GVA_StrongODR' else 'GVA_StrongExternal' end"


@query(
    "coverage_props",
    sql=f""",
c as (select enclosing_class, gva_linkage, count(*) as n from coverage_props where enclosing_class <> '' group by all),
m as (select enclosing_class, arg_max(gva_linkage, n * 10 - gva_linkage) as m from c group by 1 having sum(n) > 1 and count(*) > 1)
select enclosing_class, signature, {_GVA.format("gva_linkage")} as linkage, {_GVA.format("m")} as majority from coverage_props join m using (enclosing_class) where gva_linkage <> m""",
)
def coverage_mismatch(read: Facts) -> DataFrame:
    return checks.coverage_mismatch(read("coverage_props"))


@query(
    "coverage_props",
    sql=""",
a as (select *, body_stmt_count <= 8 or is_trivial as small from coverage_props where enclosing_class <> '')
select x.enclosing_class, x.gva_linkage, count(distinct x.signature) as small, count(distinct y.signature) as large, count(*) as pairs
from a x join a y on x.enclosing_class = y.enclosing_class and x.gva_linkage = y.gva_linkage and x.small and not y.small group by 1, 2""",
)
def coverage_divergence(read: Facts) -> DataFrame:
    return checks.coverage_divergence(read("coverage_props"))


def _functions(read: Facts) -> tuple[DataFrame, DataFrame]:
    flat, calls, globals_ = read("fn_flat"), read("fn_calls"), read("fn_globals")
    none = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c)
    called = calls.groupBy("caller").agg(F.collect_list("callee").alias("called_functions"), F.collect_list(F.when(F.col("unguarded"), F.col("callee"))).alias("unguarded_calls"))
    refs = globals_.groupBy("func").agg(F.collect_list("global").alias("referenced_globals"))
    rows = flat.join(called, F.col("qualified_name") == F.col("caller"), "left").join(refs, F.col("qualified_name") == F.col("func"), "left")
    lists = [none("called_functions"), none("unguarded_calls"), none("referenced_globals")]
    base = rows.select("qualified_name", "file_path", "line", "is_noexcept", "has_uncaught_throw", "dynamic_init", "is_constructor_fn", *lists)
    return base, base.withColumn("seq", F.col("line").cast("long"))


_CHAIN = """,
w as (select {root} as root, {start} as func, {start} as chain, 1 as depth from {source}
  union select w.root, c.callee, w.chain || ' -> ' || c.callee, w.depth + 1 from w join fn_calls c on c.caller = w.func {on} where w.depth < {depth})"""


@query(
    "fn_flat",
    "fn_calls",
    "fn_globals",
    sql=_CHAIN.format(root="f.qualified_name", start="c.callee", source="fn_flat f join fn_calls c on c.caller = f.qualified_name where f.dynamic_init and not f.is_constructor_fn", on="", depth=16)
    + """,
hit as (select f.qualified_name as root, f.file_path, g.global as target, '' as chain from fn_flat f join fn_globals g on g.func = f.qualified_name where f.dynamic_init and not f.is_constructor_fn
  union all select w.root, f.file_path, g.global, w.chain from w join fn_globals g on g.func = w.func join fn_flat f on f.qualified_name = w.root)
select root, target, arg_min(h.chain, (length(h.chain), h.chain)) as chain from hit h join fn_flat t on t.qualified_name = h.target
where t.dynamic_init and t.file_path <> h.file_path and root <> target group by 1, 2""",
)
def static_init_order(read: Facts) -> DataFrame:
    summaries, statics = _functions(read)
    return checks.static_init_order(statics, summaries)


@query(
    "fn_flat",
    "fn_calls",
    sql=_CHAIN.format(
        root="f.qualified_name",
        start="c.callee",
        source="fn_flat f join fn_calls c on c.caller = f.qualified_name and c.unguarded where f.is_noexcept and not f.has_uncaught_throw",
        on="and c.unguarded join fn_flat x on x.qualified_name = w.func and not x.is_noexcept",
        depth=16,
    )
    + """,
hit as (select root, func as target, chain, depth from w join fn_flat t on t.qualified_name = w.func where t.has_uncaught_throw),
r as (select *, row_number() over (partition by root order by depth, chain) as n from hit)
select root, target, chain from r where n = 1 union all select qualified_name, qualified_name, '' from fn_flat where is_noexcept and has_uncaught_throw""",
)
def exception_escape(read: Facts) -> DataFrame:
    summaries, _ = _functions(read)
    return checks.exception_escape(summaries)


@query(
    "fn_flat",
    "fn_calls",
    sql=_CHAIN.format(root="f.qualified_name", start="f.qualified_name", source="fn_flat f where f.dynamic_init and f.is_constructor_fn", on="", depth=25)
    + """,
v as (select * from w union select f.qualified_name, c.callee, c.callee, 1 from fn_flat f join fn_calls c on c.caller = f.qualified_name where f.dynamic_init),
v2 as (select root, func, chain, depth from v union select v2.root, c.callee, v2.chain || ' -> ' || c.callee, v2.depth + 1 from v2 join fn_calls c on c.caller = v2.func where v2.depth < 25),
r as (select *, row_number() over (partition by root order by depth, chain) as n from v2 where func in ('p:1000', 'p:1500'))
select root, func as target, chain from r where n = 1""",
)
def static_init_hazards(read: Facts) -> DataFrame:
    _, statics = _functions(read)
    return checks.static_init_hazards(statics, read("fn_calls"), ("p:1000", "p:1500"))


def _lists(read: Facts) -> tuple[DataFrame, DataFrame]:
    calls = read("adl_flat").select("tu_path", "call_location", "qualified_name", F.array("r0", "r1").alias("resolved_param_types"), F.array("a0", "a1").alias("arg_types"))
    return calls, read("overloads_flat").select("seq", "qualified_name", "header_path", F.array("t0", "t1").alias("param_types"), "source_line")


def _norm(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({c}, '\\b(const|volatile)\\b', '', 'g'), '&+$', ''), '[ \\t\\n\\r]', '', 'g')"


_ARITH = ", ".join(f"'{t}'" for t in scalars.ARITHMETIC)


def _adl_sql(kind: str) -> str:
    score = lambda t, r, a: f"case when {t} = {a} then 2 when {t} = {r} then 1 when {t} in ({_ARITH}) and {a} in ({_ARITH}) then 1 else 0 end"
    return f""",
u as (select distinct qualified_name, header_path, t0, t1 from overloads_flat),
p as (select a.*, u.header_path, t0, t1, {_norm("t0")} as p0, {_norm("t1")} as p1, {_norm("r0")} as n0, {_norm("r1")} as n1, {_norm("a0")} as b0, {_norm("a1")} as b1
  from adl_flat a join u using (qualified_name)
  where (select count(*) from u v where v.qualified_name = a.qualified_name) > 1 and not (t0 = r0 and t1 = r1)
    and not exists (select 1 from tu_includes i where i.tu_path = a.tu_path and i.file = u.header_path)),
s as (select distinct call_location, tu_path, qualified_name, header_path, t0, t1, r0, r1, {score("p0", "n0", "b0")} as x0, {score("p1", "n1", "b1")} as x1, {score("n0", "n0", "b0")} as y0, {score("n1", "n1", "b1")} as y1 from p),
k as (select *, x0 > y0 or x1 > y1 as better, x0 < y0 or x1 < y1 as worse from s where x0 > 0 and x1 > 0 and y0 > 0 and y1 > 0)
select case when better and not worse then 'ADL_Fallback' when better then 'ADL_Ambiguity' else 'ADL_SameScore' end as kind, call_location,
  qualified_name || '(' || r0 || ', ' || r1 || ')' as resolved_decl, qualified_name || '(' || t0 || ', ' || t1 || ')' as better_decl, header_path as missing_header
from k where {kind}"""


_ADL = ("adl_flat", "overloads_flat", "tu_includes")


@query(*_ADL, sql=_adl_sql("better"))
def adl_visibility(read: Facts) -> DataFrame:
    calls, overloads = _lists(read)
    return checks.adl(calls, overloads, read("tu_includes"))


@query(*_ADL, sql=_adl_sql("better or not worse"))
def adl_same_score(read: Facts) -> DataFrame:
    calls, overloads = _lists(read)
    return checks.adl(calls, overloads, read("tu_includes"), same_score=True)


@query(
    "ctad_vars",
    "deduction_guides",
    "tu_includes",
    sql="""select distinct v.call_location, v.template_name, v.deduced_type, g.deduced_type as other, g.header_path as missing_header from ctad_vars v join deduction_guides g using (template_name)
where v.deduced_type <> g.deduced_type and not exists (select 1 from tu_includes i where i.tu_path = v.tu_path and i.file = g.header_path)""",
)
def ctad_fallback(read: Facts) -> DataFrame:
    return checks.ctad(read("ctad_vars"), read("deduction_guides"), read("tu_includes"))


@query(
    "instantiations",
    "specializations",
    "tu_includes",
    sql="""select n.tu_path, n.template_name, n.args_string, s.header_path as missing_header, min(n.point_of_instantiation) as at from instantiations n join specializations s using (template_name, args_string)
where not exists (select 1 from tu_includes i where i.tu_path = n.tu_path and i.file = s.header_path) group by 1, 2, 3, 4""",
)
def specialization_invisible(read: Facts) -> DataFrame:
    return checks.specializations(read("instantiations"), read("specializations"), read("tu_includes"))


@query(
    "type_bases",
    "type_ctor_edges",
    "type_conv_edges",
    sql=""",
up as (select derived, base from type_bases where derived <> base union select u.derived, b.base from up u join type_bases b on u.base = b.derived)
select derived as from_type, base as to_type from up where derived <> base union select from_type, to_type from type_ctor_edges union select from_type, to_type from type_conv_edges""",
)
def type_convertible(read: Facts) -> DataFrame:
    return checks.convertible(read("type_bases"), read("type_ctor_edges"), read("type_conv_edges"))


@query("overloads_flat", sql=f"select seq, {_norm('t0')} as n0, {_norm('t1')} as n1 from overloads_flat")
def normalize_types(read: Facts) -> DataFrame:
    return read("overloads_flat").select("seq", scalars.normalize_type(F.col("t0")).alias("n0"), scalars.normalize_type(F.col("t1")).alias("n1"))


# Maintenance

_GONE = f"select {_EDGE}, count(*) as refs from edge_tus group by all having count_if(tu_path not in ('tu3', 'tu4')) = 0"


@query("edge_tus", sql=_GONE)
def tu_removal(read: Facts) -> DataFrame:
    """The edges that go with two units."""
    rows = read("edge_tus")
    tus = rows.sparkSession.createDataFrame([("tu3",), ("tu4",)], "tu_path string")
    return merge.remove_tus(rows, tus)[1]


@query("edge_tus", sql="select kind, confidence, count(*) as n, cast(sum(refs) as bigint) as refs from (select caller, callee, call_site, kind, confidence, exec_context, indirection_depth, count(*) as refs from edge_tus group by all) group by all")
def shard_absorb(read: Facts) -> DataFrame:
    """Sixteen unit shards merged again are the whole."""
    rows = read("edge_tus")
    shards = [rows.where(F.col("tu_path") == f"tu{i}") for i in range(16)]
    return edges.stored(merge.absorb("edge_tus", shards)).groupBy("kind", "confidence").agg(F.count("*").alias("n"), F.sum("refs").cast("long").alias("refs"))


@query(
    "stamps_old",
    "stamps_new",
    sql="""select coalesce(a.path, b.path) as path, case when a.path is null then 'new' when b.path is null then 'dropped' when a.mtime_ns = b.mtime_ns and a.size = b.size then 'same' else 'changed' end as state
from stamps_old a full join stamps_new b on a.path = b.path""",
)
def stamp_diff(read: Facts) -> DataFrame:
    return merge.stamp_diff(read("stamps_old"), read("stamps_new"))


@query(
    "journal",
    sql=""",
l as (select tu_path, max_by(stamp, seq) as stamp from journal group by 1),
d as (select tu_path, max(seq) as done from journal join l using (tu_path, stamp) where state = 'purchase' group by 1)
select tu_path, stamp, count(*) filter (state <> 'purchase' and (done is null or seq > done)) as attempts from journal join l using (tu_path, stamp) left join d using (tu_path) group by 1, 2""",
)
def journal_replay(read: Facts) -> DataFrame:
    return merge.attempts(read("journal"), done="purchase")


@query("build_stats", sql="select phase, count(*) as n, count(*) filter (tool_status <> 0) as failed, cast(sum(ms) as bigint) as total_ms, max(ms) as max_ms from build_stats group by 1")
def build_stats(read: Facts) -> DataFrame:
    return merge.build_stats(read("build_stats"))


@query("build_stats", sql="select file, cast(sum(ms) as bigint) as ms from build_stats group by 1 order by 2 desc, 1 limit 5")
def slowest_files(read: Facts) -> DataFrame:
    return merge.slowest(read("build_stats"))


# Rewriting

_RULES = [rewrite.Pass("notices", (rewrite.Rule("Licensed?", "[{{root}}]"), rewrite.Rule("MIT Licensed?", "MIT")))]


@query("texts", sql="select file, cast(len(regexp_extract_all(text, 'Licensed?')) as bigint) + cast(len(regexp_extract_all(text, 'MIT Licensed?')) as bigint) as n from texts where contains(text, 'License')")
def morph_replacements(read: Facts) -> DataFrame:
    return rewrite.replacements(read("texts"), _RULES).groupBy("file").agg(F.count("*").alias("n"))


@query("texts", sql="select file, cast(len(regexp_extract_all(text, 'MIT Licensed?')) as bigint) as rejected from texts where contains(text, 'MIT License')")
def morph_conflicts(read: Facts) -> DataFrame:
    """The longer pattern comes second and overlaps what the first has taken."""
    found = rewrite.accepted(rewrite.replacements(read("texts"), _RULES)).where("rejected")
    return found.groupBy("file").agg(F.count("*").alias("rejected"))


@query("texts", sql="select file, md5(regexp_replace(text, '(Licensed?)', '[\\1]', 'g')) as new_md5 from texts")
def morph_apply(read: Facts) -> DataFrame:
    return rewrite.run(read("texts"), _RULES).select("file", F.md5("new_text").alias("new_md5"))
