"""Queries over names, paths, contexts, locks, channels and liveness, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators import channels, contexts, edges, exceptions, fixpoint, identity, liveness, paths, summary
from callweave.plans.queries import _ALIVE, _EDGE, _ESTAR, _GRAPH, _PATHS, _PROVEN, _SURE, Facts, _chains, query

# Names


@query("nodes", sql="select min(usr) as usr, min(qualified_name) as qualified_name, max(total) as total from (select *, count(*) over () as total from nodes where qualified_name = (select min(qualified_name) from (select qualified_name from nodes group by 1 having count(*) > 1)) order by usr limit 25) group by usr")
def ambiguous_candidates(read: Facts) -> DataFrame:
    """The candidates that are listed for the first ambiguous name, and their number."""
    found = _ambiguous(read)
    return found.candidates.select("usr", "qualified_name", F.lit(found.total).cast("long").alias("total"))


@query("nodes", sql="select file, count(*) as n from nodes where qualified_name = (select min(qualified_name) from (select qualified_name from nodes group by 1 having count(*) > 1)) group by file")
def ambiguous_by_file(read: Facts) -> DataFrame:
    """Of all candidates of that name the number in each file."""
    return _ambiguous(read).by_file


def _ambiguous(read: Facts) -> identity.Ambiguous:
    nodes = read("nodes")
    name = nodes.groupBy("qualified_name").count().where("count > 1").agg(F.min("qualified_name")).first()[0]
    found = identity.resolve(nodes, read("edges"), name=name)
    assert isinstance(found, identity.Ambiguous)
    return found


@query("nodes", "edges", sql="select 'Order#7' as asked, usr from nodes where qualified_name = 'Order#7' union all select 'p:9', usr from nodes where usr = 'p:9' union all select 'p:0', 'p:0' from edges where (caller = 'p:0' or callee = 'p:0') limit 3")
def name_candidates(read: Facts) -> DataFrame:
    """What a display name, a usr and an end of an edge alone may mean."""
    out = None
    for name in ("Order#7", "p:9", "p:0"):
        rows = identity.candidates(read("nodes"), read("edges"), name).select(F.lit(name).alias("asked"), "usr")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("call_sites_flat", sql="select distinct callee_usr as usr from call_sites_flat where call_site = 'order.cpp:7:2'")
def resolve_site(read: Facts) -> DataFrame:
    """The function that is called at a site."""
    found = identity.resolve(read("nodes"), read("edges"), read("call_sites"), site="order.cpp:7:2")
    return read("nodes").sparkSession.createDataFrame([(found.usr,)], "usr string")


@query("nodes", sql="select 'Order#1' as name, usr, qualified_name, file, line from nodes where qualified_name = 'Order#1' union all select 'c:5', usr, qualified_name, file, line from nodes where usr = 'c:5' union all select 'nowhere', null, null, null, null")
def list_entry_points(read: Facts) -> DataFrame:
    """Configured entry points, as far as they are known."""
    return identity.entry_points(read("nodes"), ["Order#1", "c:5", "nowhere"])


@query("nodes", sql="select qualified_name as name, usr, qualified_name, file, line from nodes where is_entry_point")
def graph_entry_points(read: Facts) -> DataFrame:
    return identity.entry_points(read("nodes"))


@query("effective_impls", sql="select distinct concrete_class from effective_impls where impl_method = 'p:45'")
def classes_for_impl(read: Facts) -> DataFrame:
    """The classes that a method is the implementation for."""
    return identity.classes_for(read("effective_impls"), read("nodes"), read("edges"), "p:45")


@query("overloads_flat", "deduction_guides", "specializations", "fn_flat", "odr_entries", sql="""
select 'overload' as what, count(*) as n from overloads_flat where qualified_name = (select min(qualified_name) from overloads_flat)
union all select 'guide', count(*) from deduction_guides where template_name = (select min(template_name) from deduction_guides)
union all select 'specialization', count(*) from specializations where template_name = (select min(template_name) from specializations)
union all select 'function', count(*) from fn_flat where qualified_name = 'p:7'
union all select 'method', count(*) from odr_entries where enclosing_class = (select max(enclosing_class) from odr_entries)""")
def declarations_by_name(read: Facts) -> DataFrame:
    """Declarations of one name in each table that lists some."""
    out = None
    for what, table, column, pick in (("overload", "overloads_flat", "qualified_name", F.min), ("guide", "deduction_guides", "template_name", F.min), ("specialization", "specializations", "template_name", F.min), ("function", "fn_flat", "qualified_name", None), ("method", "odr_entries", "enclosing_class", F.max)):
        rows = read(table)
        name = rows.agg(pick(column)).first()[0] if pick else "p:7"
        found = identity.methods_of(rows, name) if what == "method" else identity.by_name(rows, name, column)
        row = found.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query(*_GRAPH, sql=f"{_ESTAR} select e.*, coalesce(a.qualified_name, e.caller) as caller_name, coalesce(b.qualified_name, e.callee) as callee_name from (select {_EDGE} from estar where caller = 'p:3') e left join nodes a on a.usr = e.caller left join nodes b on b.usr = e.callee")
def named_edges(read: Facts) -> DataFrame:
    return edges.materialised(edges.callees(read("edges"), read("method_overrides"), read("function_returns"), "p:3"), read("nodes"))


@query("nodes", "edges", sql="select call_site, nullif(indirection_depth, 0) as indirection_depth, nullif(exec_context, 'Synchronous') as exec_context, coalesce(qualified_name, callee) as callee_name from edges left join nodes on usr = callee where caller = 'c:7'")
def edge_projection(read: Facts) -> DataFrame:
    """Edges of an answer: what is at its default is left out."""
    rows = edges.projected(read("edges").drop("refs").where("caller = 'c:7'"), read("nodes"))
    return rows.select("call_site", "indirection_depth", "exec_context", "callee_name")


@query(*_GRAPH, sql=f"""{_ESTAR}, t as (select coalesce(qualified_name, callee) as target, call_site, caller, kind from estar left join nodes on usr = callee where kind in ('FunctionPointer', 'LambdaCall'))
select target, count(*) as site_count, md5(string_agg(call_site || '|' || caller || '|' || kind, ',' order by call_site, caller, kind)) as sites from t group by 1""")
def callback_sites(read: Facts) -> DataFrame:
    """Functions that are called back, with a digest of the list of their sites."""
    rows = summary.callback_sites(read.view.narrow(edges.EdgeFilter(("FunctionPointer", "LambdaCall"))).distinct(), read("nodes"))
    listed = F.array_join(F.transform("sites", lambda s: F.concat_ws("|", s["call_site"], s["caller"], s["kind"])), ",")
    return rows.select("target", "site_count", F.md5(listed).alias("sites"))


# Contexts

_RECORD = "call_site, caller_usr, callee_usr, has_scope as is_under_try_catch, caller_noexcept = 'Noexcept' as would_terminate_if_throws, cast(has_scope as bigint) as try_scope_count, cast(1 as bigint) as guard_count"


def _record(rows: DataFrame) -> DataFrame:
    return rows.select("call_site", "caller_usr", "callee_usr", "is_under_try_catch", "would_terminate_if_throws", "try_scope_count", "guard_count")


@query("call_sites_flat", sql=f"select {_RECORD} from call_sites_flat where call_site = 'order.cpp:7:2'")
def query_call_site(read: Facts) -> DataFrame:
    """The first context at a site."""
    return _record(contexts.query_call_site(read("call_sites"), "order.cpp:7:2"))


@query(sql="select 'nowhere.cpp:1:1' as call_site, '' as caller_usr, '' as callee_usr, false as is_under_try_catch, false as would_terminate_if_throws, cast(0 as bigint) as try_scope_count, cast(0 as bigint) as guard_count")
def query_call_site_empty(read: Facts) -> DataFrame:
    """A site without a context: an empty record."""
    return _record(contexts.query_call_site(read("call_sites"), "nowhere.cpp:1:1"))


@query("call_sites_flat", sql=f"select {_RECORD} from call_sites_flat where call_site = 'order.cpp:7:2' and (caller_usr = 'Order#7' or caller_name = 'Order#7')")
def context_of_caller(read: Facts) -> DataFrame:
    """The contexts at a site for one caller, here by name."""
    return _record(contexts.described(contexts.at_site(read("call_sites"), "order.cpp:7:2", "Order#7")))


@query("call_sites_flat", sql="select caller_usr, callee_usr, call_site, min(seq) as seq from (select *, row_number() over (partition by caller_usr, callee_usr order by seq, tu_path) as r from call_sites_flat) where r = 1 group by all")
def first_contexts(read: Facts) -> DataFrame:
    """The first context of every (caller, callee)."""
    return contexts.first_by(read("call_sites"), "caller_usr", "callee_usr").select("caller_usr", "callee_usr", "call_site", "seq")


@query("call_sites_flat", sql="select regexp_extract(call_site, '^(.+):([0-9]+):([0-9]+)$', 1) as file, count(*) as n, count(*) filter (regexp_matches(call_site, '^.+:[0-9]+:[0-9]+$')) as valid, max(cast(regexp_extract(call_site, '^(.+):([0-9]+):([0-9]+)$', 2) as integer)) as line, sum(cast(regexp_extract(call_site, '^(.+):([0-9]+):([0-9]+)$', 3) as integer)) :: bigint as columns from call_sites_flat group by 1")
def site_locations(read: Facts) -> DataFrame:
    """Sites as file, line and column."""
    from callweave.functions.scalars import location, parse_location

    rows = read("call_sites").select("call_site", parse_location(F.col("call_site")).alias("x"))
    rows = rows.withColumn("again", location(F.col("x.file"), F.col("x.line"), F.col("x.column")))
    valid = F.count_if(contexts.is_call_site(F.col("call_site")) & (F.col("again") == F.col("call_site")))
    return rows.groupBy("x.file").agg(F.count("*").alias("n"), valid.alias("valid"), F.max("x.line").alias("line"), F.sum("x.column").alias("columns"))


@query("call_sites_flat", sql="select call_site, caller_name, callee_name, has_scope as protected, case when caller_noexcept <> 'None' then caller_noexcept end as caller_noexcept, condition_text, in_true_branch, type_name from call_sites_flat where caller_usr in ('o:1', 'o:2', 'o:3', 'o:4', 'o:5')")
def context_dump(read: Facts) -> DataFrame:
    """Contexts written as JSON, fields at their default left out, and read again."""
    from callweave.plans.schema import struct

    rows = read("call_sites").where(F.col("caller_usr").isin(*[f"o:{i}" for i in range(1, 6)]))
    back = contexts.dump(rows).select(F.from_json("value", struct("call_sites")).alias("x"))
    one = lambda c, f: F.get(F.col(f"x.{c}"), 0)[f].alias(f)
    return back.select("x.call_site", "x.caller_name", "x.callee_name", F.col("x.try_scopes").isNotNull().alias("protected"), "x.caller_noexcept", one("guards", "condition_text"), one("guards", "in_true_branch"), one("raii_locals", "type_name"))


# Paths

_TOP = """, ranked as (select row_number() over (order by length, nodes, sites) as rank, * from back where starts_with(head, 'r:') order by rank limit {most}),
hops as (select rank, length, i as pos, nodes[i] as caller, nodes[i + 1] as callee, sites[i] as site from ranked, range(1, 40) t(i) where i <= length),
pair as (select * from (select *, row_number() over (partition by caller_usr, callee_usr order by seq, tu_path) as r from call_sites_flat) where r = 1),
ctx as (select h.*, p.has_scope, p.try_location, p.caught_type, p.is_catch_all, p.caller_noexcept, p.callee_usr is not null as known from hops h left join pair p on p.caller_usr = h.caller and p.callee_usr = h.callee)
"""
_CAUGHT = """, hit as (select rank, pos, try_location, case when is_catch_all then '...' else caught_type end as by_ , row_number() over (partition by rank order by pos) as r
  from ctx where has_scope and (is_catch_all or caught_type in ('std::runtime_error', 'std::exception'))),
rated as (select k.rank, k.length, k.nodes, h.rank is not null as caught, coalesce(try_location, '') as caught_at, coalesce(by_, '') as caught_by from ranked k left join (select * from hit where r = 1) h using (rank))
"""


@query(*_GRAPH, "call_sites_flat", sql=f"{_PROVEN}{_PATHS}{_TOP.format(most=100)}{_CAUGHT} select cast(rank as integer) as rank, cast(length as integer) as length, caught, caught_at, caught_by from rated")
def exception_protection(read: Facts) -> DataFrame:
    """Of every path where an exception is caught, and by what."""
    return exceptions.protection(_chains(read, 100), read("call_sites"), "std::runtime_error")


@query(*_GRAPH, "call_sites_flat", sql=f"{_PROVEN}{_PATHS}{_TOP.format(most=100)}{_CAUGHT} select cast(rank as integer) as rank, caught_at from rated where caught")
def throw_propagation(read: Facts) -> DataFrame:
    """The same from the side of the throw: the paths on which it is caught."""
    found = exceptions.throw_propagation(_chains(read, 100), read("call_sites"), "std::runtime_error")
    return found.where("caught").select("rank", "caught_at")


@query(*_GRAPH, "call_sites_flat", sql=f"""{_PROVEN}{_PATHS}{_TOP.format(most=100)}{_CAUGHT}, v as (select count(*) as n, count(*) filter (caught) as c from rated)
select case when n = 0 then 'unknown' when c = n then 'always_caught' when c = 0 then 'never_caught' else 'sometimes_caught' end as protection, n as total_paths, c as caught_paths,
 'std::runtime_error from p:45 is caught on ' || case when c = n then 'all ' || n || ' paths.' || (select ' First by ' || caught_by || ' at ' || caught_at || '.' from rated where rank = 1) when c = 0 then 'none of ' || n || ' paths.'
 else c || ' of ' || n || ' paths. Not on: ' || (select array_to_string(arg_min(nodes, rank), ' -> ') from rated where not caught) || '.' end as summary from v""")
def exception_verdict(read: Facts) -> DataFrame:
    """Whether all, some or none of the paths are protected, in a sentence."""
    found = fixpoint.cut(_chains(read, 100))
    return exceptions.verdict(exceptions.protection(found, read("call_sites"), "std::runtime_error"), found, "p:45", "std::runtime_error")


@query(*_GRAPH, "call_sites_flat", sql=f"{_PROVEN}{_PATHS}{_TOP.format(most=100)} select cast(k.rank as integer) as rank, cast(k.length as integer) as length, cast(count(*) filter (has_scope) as integer) as scopes, cast(count(*) filter (known) as integer) as guards, coalesce(bool_or(caller_noexcept = 'Noexcept'), false) as has_noexcept_barrier from ranked k left join ctx c using (rank) group by k.rank, k.length")
def all_path_contexts(read: Facts) -> DataFrame:
    """Scopes and guards of every path."""
    found = exceptions.path_contexts(_chains(read, 100), read("call_sites"))
    return found.select("rank", "length", F.size("scopes").alias("scopes"), F.size("guards").alias("guards"), "has_noexcept_barrier")


@query(*_GRAPH, "call_sites_flat", sql=f"""{_PROVEN},
pair as (select * from (select *, row_number() over (partition by caller_usr, callee_usr order by seq, tu_path) as r from call_sites_flat) where r = 1),
calls as (select distinct e.caller, e.callee, case when p.has_scope then p.try_location end as try_location from pe e left join pair p on p.caller_usr = e.caller and p.callee_usr = e.callee),
walk as (select 'p:45' as node, 0 as d union select c.caller, w.d + 1 from walk w join calls c on c.callee = w.node where c.try_location is null and w.d < 4),
near as (select node, min(d) as d from walk group by node)
select c.caller, c.callee, cast(min(n.d) + 1 as integer) as frames, min(c.try_location) as try_location from near n join calls c on c.callee = n.node where c.try_location is not null and n.d < 4 group by 1, 2""")
def nearest_catches(read: Facts) -> DataFrame:
    """Going up from a function, the first calls under a try on each branch."""
    view = read.view.narrow(_SURE)
    return exceptions.nearest_catches("p:45", view, read("call_sites"), 4)


_HUBS = """, hubs_ as (select callee from edges group by callee having count(*) > 100),
back as (select '{target}' as head, ['{target}'] as nodes, [] :: varchar[] as sites, [] :: varchar[] as used, 0 as length
  union all select e.caller, list_prepend(e.caller, b.nodes), list_prepend(e.call_site, b.sites), list_append(b.used, e.caller || ' ' || e.callee || ' ' || e.call_site || ' ' || e.kind || ' ' || e.exec_context), b.length + 1
  from back b join pe e on e.callee = b.head where b.length < 6 and not starts_with(b.head, 'r:') and (b.head = '{target}' or b.head not in (select callee from hubs_))
    and not list_contains(b.used, e.caller || ' ' || e.callee || ' ' || e.call_site || ' ' || e.kind || ' ' || e.exec_context))
"""
_LOCKS = """, one as (select * from (select *, row_number() over (partition by call_site order by seq, callee_usr, tu_path) as r from call_sites_flat) where r = 1),
own as (select * from (select *, row_number() over (partition by call_site, caller_usr order by seq, callee_usr, tu_path) as r from call_sites_flat) where r = 1),
held as (select h.rank, h.pos, h.site, coalesce(o.type_name, a.type_name) as type_name, coalesce(o.var_name, a.var_name) as var_name, coalesce(o.raii_kind, a.raii_kind) as kind
  from hops h left join own o on o.call_site = h.site and o.caller_usr = h.caller left join one a on a.call_site = h.site),
locks as (select rank, type_name, var_name, arg_max(site, pos) as held_at from held where kind = 'lock' group by 1, 2, 3)
"""


def _lock_paths(read: Facts, target: str) -> DataFrame:
    view = read.view.narrow(_SURE)
    starts = read("nodes").where("is_entry_point").select(F.col("usr").alias("node"))
    return paths.find_paths(starts, target, view, 6, 512, 100, read("edges"), edge_simple=True)


@query(*_GRAPH, "call_sites_flat", sql=f"{_PROVEN}{_HUBS.format(target='p:45')}{_TOP.format(most=512)}{_LOCKS} select cast(rank as integer) as rank, nodes[1] as entry, type_name, var_name, held_at from locks join ranked using (rank)")
def locks_held(read: Facts) -> DataFrame:
    """Locks held along the paths to a function; edges are walked once a path, hubs are not entered from behind."""
    return exceptions.locks_on_paths(_lock_paths(read, "p:45"), read("call_sites")).select("rank", "entry", "type_name", "var_name", "held_at")


@query(*_GRAPH, "call_sites_flat", sql=f"""{_PROVEN}, a_ as (with recursive dummy as (select 1) {_HUBS.format(target='p:45')}{_TOP.format(most=512)}{_LOCKS} select distinct type_name, var_name from locks),
b_ as (with recursive dummy as (select 1) {_HUBS.format(target='p:48')}{_TOP.format(most=512)}{_LOCKS} select distinct type_name, var_name from locks)
select coalesce(a_.type_name, b_.type_name) as type_name, coalesce(a_.var_name, b_.var_name) as var_name, a_.type_name is not null as on_a, b_.type_name is not null as on_b from a_ full join b_ on a_.type_name = b_.type_name and a_.var_name = b_.var_name""")
def same_lock(read: Facts) -> DataFrame:
    """Locks that are held on the way to one or both of two functions."""
    return exceptions.same_locks(*[exceptions.locks_on_paths(_lock_paths(read, t), read("call_sites")) for t in ("p:45", "p:48")])


@query("edges", sql=""",
hubs_ as (select callee as node from edges group by callee having count(*) > 100),
open_ as (select caller, callee from edges where callee = 'p:45' or callee not in (select node from hubs_)),
walk as (select 'p:45' as node, 0 as d union select e.caller, w.d + 1 from walk w join open_ e on e.callee = w.node where w.d < 6)
select distinct node from walk where node in (select node from hubs_) and node <> 'p:45'""")
def skipped_hubs(read: Facts) -> DataFrame:
    """Hubs within reach that were not entered for their callers."""
    plain = read("edges").drop("refs")
    return paths.skipped_hubs(plain.limit(0).select(F.col("caller").alias("node")), "p:45", plain, read("edges"), 6, 100)


@query("call_sites_flat", sql="""select e.name as exception, count(*) as n from call_sites_flat c join (values ('std::out_of_range', ['std::out_of_range', 'std::logic_error', 'std::exception']),
 ('std::runtime_error', ['std::runtime_error', 'std::exception']), ('int', ['int'])) e(name, bases) on c.has_scope and (c.is_catch_all or list_contains(e.bases, c.caught_type)) group by 1""")
def exception_subtypes(read: Facts) -> DataFrame:
    """Contexts that catch an exception through its bases."""
    out = None
    for name in ("const std::out_of_range &", "std::runtime_error", "int"):
        found = read("call_sites").where(F.exists("try_scopes", lambda s: exceptions.catches(s["handlers"], name)))
        row = found.agg(F.lit(exceptions.bare_type(name)).alias("exception"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


# Liveness

_RATED = f"{_ESTAR}{_ALIVE}, rated as (select qualified_name, min(file) as file, count(node) > 0 as live from nodes left join seen on usr = node group by qualified_name)"


def _rated(read: Facts) -> DataFrame:
    """Names by proven reachability alone."""
    nodes = read("nodes")
    sure = liveness.alive(nodes.where("is_entry_point").select(F.col("usr").alias("node")), read.view.narrow(_SURE))
    rows = nodes.join(sure.withColumn("_a", F.lit(True)), F.col("usr") == F.col("node"), "left")
    best = rows.groupBy("qualified_name").agg(F.count("_a").alias("_n"), F.min("file").alias("file"))
    return best.select("qualified_name", "file", F.when(F.col("_n") > 0, "alive").otherwise("dead").alias("verdict"))


@query(*_GRAPH, sql=f"{_RATED} select qualified_name, file, 'dead' as verdict from rated where not live and starts_with(qualified_name, 'Order#') and starts_with(file, '/w/src/') order by qualified_name limit 40 offset 10")
def dead_code_page(read: Facts) -> DataFrame:
    """One page of the dead functions of a prefix."""
    return liveness.dead(_rated(read), name_prefix="Order#", file_prefix="/w/src/", limit=40, offset=10)


@query(*_GRAPH, sql=f"{_RATED} select case when live then 'alive' else 'dead' end as verdict, count(*) as n from rated group by 1")
def dead_code_counts(read: Facts) -> DataFrame:
    return liveness.counts(_rated(read))


@query(*_GRAPH, sql=f"{_RATED} select 'DeadCode' as kind, file as call_location, qualified_name as resolved_decl, 'unreachable from every entry point: ' || qualified_name as message, 'dead-code' as check_name from rated where not live and not starts_with(file, '<')")
def dead_code_diagnostics(read: Facts) -> DataFrame:
    return liveness.diagnostics(_rated(read)).select("kind", "call_location", "resolved_decl", "message", "check_name")


_OPTIMISTIC = f"""{_ESTAR},
free as (select distinct caller as src, callee as dst from estar where not (kind = 'VirtualDispatch' and confidence = 'Plausible')),
gated as (select distinct caller, callee from estar where kind = 'VirtualDispatch' and confidence = 'Plausible'),
own as (select usr as callee, enclosing_class as class from nodes where enclosing_class <> ''),
needs as (select callee, class from own union select impl_method, concrete_class from effective_impls),
built as (select distinct e.caller, o.class from estar e join own o using (callee) where e.kind = 'ConstructorCall'),
opens as (select distinct g.caller as src, g.callee as dst, n.class from gated g join needs n using (callee)),
state(tag, v) using key (tag, v) as (
  select 'n' as tag, usr as v from nodes where is_entry_point
  union (
    select 'n', f.dst from state s join free f on s.tag = 'n' and f.src = s.v
    union select 'c', b.class from state s join built b on s.tag = 'n' and b.caller = s.v
    union select 'n', o.dst from state s join opens o on s.tag = 'n' and o.src = s.v join recurring.state r on r.tag = 'c' and r.v = o.class
    union select 'n', o.dst from state s join opens o on s.tag = 'c' and o.class = s.v join recurring.state r on r.tag = 'n' and r.v = o.src
  )),
sure as (select usr as node from nodes where is_entry_point union select e.callee from sure s join estar e on e.caller = s.node where e.confidence = 'Proven'),
verdicts as (select qualified_name, max(case when u.node is not null then 2 when s.v is not null then 1 else 0 end) as level from nodes left join sure u on u.node = usr left join (select distinct v from state where tag = 'n') s on s.v = usr group by 1)
"""


@query(*_GRAPH, "effective_impls", sql=f"{_OPTIMISTIC} select case level when 2 then 'alive' when 1 then 'optimistic' else 'dead' end as verdict, count(*) as n from verdicts group by 1")
def dead_code_optimistic(read: Facts) -> DataFrame:
    """Names by likely reachability too: plausible dispatch counts once a class was constructed."""
    seeds = read("nodes").where("is_entry_point").select(F.col("usr").alias("node"))
    return liveness.counts(liveness.liveness(read("nodes"), read.view.plain.unionByName(read.view.deferred).unionByName(read.view.single), seeds, read("effective_impls"), read.view))


# Channels

_CH = "select channel_id, channel_type, category, op, function_usr, function_display, call_site, count(*) as refs from channel_site_tus group by all"


@query(*_GRAPH, sql=f"""{_ESTAR},
up as (select 's:7' as node union select e.caller from up u join estar e on e.callee = u.node where e.exec_context = 'Synchronous')
select distinct {_EDGE} from estar e where exec_context <> 'Synchronous' and callee in (select node from up)""")
def concurrency_boundaries(read: Facts) -> DataFrame:
    """Where concurrency begins above a function, over the expanded view."""
    return channels.boundaries_in(read.view, "s:7")


@query("channel_site_tus", sql=f""", c as ({_CH}), both_ as (
 (select *, 'A' as side from c where call_site = 'ev.cpp:1:1' order by channel_id, function_usr, op limit 1) union all (select *, 'B' from c where call_site = 'ev.cpp:21:1' order by channel_id, function_usr, op limit 1))
select *, (select count(distinct channel_id) = 1 from both_) as same_channel from both_""")
def explain_ordering(read: Facts) -> DataFrame:
    """Two sites side by side, and whether they are on one channel."""
    both, _, _ = channels.explain_ordering(channels.counted(read("channel_site_tus")), read("edges").drop("refs"), "ev.cpp:1:1", "ev.cpp:21:1")
    return both
