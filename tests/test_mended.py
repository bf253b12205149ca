"""Removal, snapshots, journals, deltas, templates and hooks: what one table after another has to show."""

import io
import json

import pytest
from pyspark.sql import functions as F

from callweave.engine import Engine, schemas, serve
from callweave.functions import scalars
from callweave.operators import contexts, edges, exceptions, identity, merge, paths, rewrite
from callweave.plans import checkset, program
from callweave.plans.schema import rows
from callweave.sources import tables
from callweave.streaming import deltas


def edge(a, b, tu="", **more):
    return {"caller": a, "callee": b, "call_site": f"{a}.cpp:1:1", "tu_path": tu, **more}


@pytest.mark.parametrize("handler, caught, by", [("const std::exception &", True, "const std::exception &"), ("...", True, "..."), ("int", False, "")])
def test_handlers_by_reference(spark, handler, caught, by):
    g = rows(spark, "edges", [edge("main", "f")])
    scope = [{"try_location": "m:1:1", "enclosing_function": "main", "nesting_depth": 0, "handlers": [{"caught_type": handler, "is_catch_all": handler == "...", "location": "", "body_summary": ""}]}]
    sites = rows(spark, "call_sites", [{"caller_usr": "main", "callee_usr": "f", "call_site": "m:2:1", "try_scopes": scope, "guards": [], "raii_locals": []}])
    found = paths.find_paths(spark.createDataFrame([("main",)], "node string"), "f", g.drop("refs"))
    row = exceptions.protection(found, sites, "std::runtime_error").first()
    assert (row.caught, row.caught_by) == (caught, by)
    text = exceptions.verdict(exceptions.protection(found, sites, "std::runtime_error"), found, "f", "std::runtime_error").first().summary
    assert ("First by" in text) == caught and text.startswith("std::runtime_error from f is caught on ")


def test_own_exception_classes(spark):
    more = exceptions.hierarchy(rows(spark, "derived_classes", [{"base": "std::runtime_error", "derived": "mine::Error"}]))
    assert exceptions.bases("mine::Error") == ["mine::Error"]
    assert exceptions.bases("mine::Error", more) == ["mine::Error", "std::runtime_error", "std::exception"]


def test_collapse_needs_slashes_of_the_path(spark):
    df = spark.createDataFrame([("/x/src/a.cpp",), ("src/a.cpp",), ("/x/src",), ("/x/mysrc/a.cpp",)], "file string")
    assert [r.c for r in df.select(edges.collapse(F.col("file"), ["src"]).alias("c")).collect()] == [True, False, False, False]
    assert edges.skip_paths(df, "file", ["/src/"]).count() == 3


def index(spark):
    tus = [edge("a", "b", "t1"), edge("a", "b", "t2"), edge("a", "c", "t1")]
    channel = {"channel_id": "q", "op": "produce", "function_usr": "a", "function_display": "a", "call_site": "a:1:1", "guards": [], "tu_path": "t1"}
    sites = [{"caller_usr": "a", "callee_usr": "c", "call_site": "a.cpp:9:9", "tu_path": t, "try_scopes": [], "guards": [], "raii_locals": []} for t in ("t1", "t2", "")]
    found = {
        "nodes": rows(spark, "nodes", [{"usr": u, "qualified_name": u} for u in "abcz"]),
        "node_tus": rows(spark, "node_tus", [{"usr": u, "tu_path": t} for u, t in (("a", "t1"), ("a", "t2"), ("b", "t2"), ("c", "t1"))]),
        "edge_tus": rows(spark, "edge_tus", tus),
        "edges": edges.stored(rows(spark, "edge_tus", tus)).unionByName(rows(spark, "edges", [edge("z", "z")])),
        "channel_site_tus": rows(spark, "channel_site_tus", [channel]),
        "channel_sites": rows(spark, "channel_sites", [channel]),
        "call_sites": rows(spark, "call_sites", sites),
    }
    return Engine(spark, found)


def test_a_removed_unit_leaves_nothing(spark):
    engine = index(spark)
    totals = engine.call("reindex_tu", file="t1")["totals"][0]
    assert (totals["edges_removed"], totals["contexts_removed"], totals["edges_after"], totals["contexts_after"]) == (1, 1, 2, 2)
    assert {r.usr for r in engine["nodes"].collect()} == {"a", "b", "z"}  # z never had a unit
    assert engine["channel_sites"].count() == 0 and {(r.caller, r.callee, r.refs) for r in engine["edges"].collect()} == {("a", "b", 1), ("z", "z", 1)}
    engine.reindex_tu("t2", {"edge_tus": rows(spark, "edge_tus", [edge("a", "d", "t2")]), "nodes": rows(spark, "nodes", [{"usr": "d", "qualified_name": "d"}]), "node_tus": rows(spark, "node_tus", [{"usr": "d", "tu_path": "t2"}])})
    assert {r.usr for r in engine["nodes"].collect()} == {"d", "z"} and {r.callee for r in engine["edges"].collect()} == {"d", "z"}
    by_site = merge.apply_delta({"call_sites": index(spark)["call_sites"]}, "a.cpp")["call_sites"]
    assert by_site.count() == 2  # the context that names no unit goes by its site


def test_warm_start(spark):
    engine = index(spark)
    stamps = lambda *s: spark.createDataFrame(list(s), "path string, mtime_ns long, size long")
    old, same = stamps(("t1", 1, 1), ("t2", 1, 1)), stamps(("t2", 1, 1), ("t1", 1, 1))
    assert merge.warm_start(engine.tables, old, same, lambda p: {})[0] == "unchanged"
    assert merge.warm_start(engine.tables, old, same, lambda p: {}, same_config=False) == ("rebuild", None)
    state, after = merge.warm_start(engine.tables, old, stamps(("t2", 2, 1), ("t3", 1, 1)), lambda p: {"edge_tus": rows(spark, "edge_tus", [edge("n", t, t) for t in p])})
    assert state == "refreshed" and {r.callee for r in after["edges"].collect()} == {"t2", "t3", "z"}


@pytest.mark.parametrize(
    ("text", "op", "want"),
    [
        ("a && (b && c) && d", "&&", ["a", "(b && c)", "d"]),
        ("a && b || c", "&&", ["a && b || c"]),
        ("a + b - c", "+", ["a + b - c"]),
        ("a - b + c", "+", ["a - b", "c"]),
        ('f(x, y) + "p + q" + -z', "+", ["f(x, y)", '"p + q"', "-z"]),
        ("a && b ? c : d", "&&", ["a && b ? c : d"]),
        ("*p && &q", "&&", ["*p", "&q"]),
        ("x->y && z", "&&", ["x->y", "z"]),
        ("", "&&", [""]),
    ],
)
def test_flatten_stops_at_brackets_and_other_operators(text, op, want):
    assert rewrite.flatten(text, op) == want


def test_snapshot_switches_at_once(spark, tmp_path):
    folder = str(tmp_path / "s")
    one = rows(spark, "nodes", [{"usr": "a"}])
    tables.save_snapshot({"nodes": one}, folder, "c")
    # A crash after some tables of a new version were written.
    rows(spark, "nodes", [{"usr": "x"}, {"usr": "y"}]).write.parquet(f"{folder}/version-2-broken/nodes")
    assert tables.load_snapshot(spark, folder, "c")["nodes"].count() == 1
    tables.save_snapshot({"nodes": one.unionByName(one)}, folder, "c")
    assert tables.load_snapshot(spark, folder, "c")["nodes"].count() == 2
    assert len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("version-1")]) == 0


def test_late_and_empty_deltas(spark, tmp_path):
    folder, schema = str(tmp_path / "d"), "caller string, callee string, call_site string, kind string, confidence string, exec_context string, indirection_depth int, tu_path string, version int"
    put = lambda *found: deltas.apply_batch(spark.createDataFrame([(a, "b", "s", "DirectCall", "Proven", "Synchronous", 0, tu, v) if a else (None,) * 7 + (tu, v) for a, tu, v in found], schema), folder)
    callers = lambda: {r.caller for r in deltas.current_edges(spark, folder).collect()}
    put(("new", "t1", 2), ("old", "t1", 1), ("other", "t2", 1))
    put(("late", "t1", 1))
    assert callers() == {"new", "other"}
    put((None, "t2", 2))
    put(("newer", "t1", 3), ("again", "t2", 1))
    assert callers() == {"newer"}


def test_journals_and_shards(spark, tmp_path):
    record = lambda *r: spark.createDataFrame(list(r), tables.JOURNAL)
    assert tables.read_journal(spark, str(tmp_path / "j"), "c").count() == 0
    tables.append_journal(record((1, "a", "s", "try"), (2, "b", "s", "try")), str(tmp_path / "j"), "c")
    tables.append_journal(record((3, "a", "s", "done")), str(tmp_path / "j"), "c")
    assert {r.tu_path: r.state for r in tables.read_journal(spark, str(tmp_path / "j"), "c").collect()} == {"a": "done", "b": "try"}
    assert tables.read_journal(spark, str(tmp_path / "j"), "other").count() == 0
    tables.write_shard({"nodes": rows(spark, "nodes", [{"usr": "a", "file": "f"}])}, str(tmp_path / "w1"))
    tables.write_shard({"nodes": rows(spark, "nodes", [{"usr": "a", "is_virtual": True}])}, str(tmp_path / "w2"))
    found = tables.read_shards(spark, [str(tmp_path / n) for n in ("w1", "w2", "none")])
    assert [(r.usr, r.file, r.is_virtual) for r in found["nodes"].collect()] == [("a", "f", True)]


def test_hooks(spark):
    own = checkset.Registry()
    own.unit_checks["many"] = lambda units, t: units.groupBy("tu_path").count().where("count > 1").select("tu_path")
    units = rows(spark, "edge_tus", [edge("a", "b", "t1"), edge("a", "c", "t1"), edge("a", "b", "t2")])
    assert [r.tu_path for r in own.run_units(units, {}).collect()] == ["t1"]
    own.disabled.append("many")
    assert own.run_units(units, {}) is None
    own.guard_classifiers += [lambda c: F.when(c == "x", F.struct(F.lit("k").alias("kind"), c.alias("name")))]
    guards = spark.createDataFrame([("x",), ("y",)], "condition_text string")
    assert [r.guard_kind and r.guard_kind.kind for r in own.classify_guards(guards).collect()] == ["k", None]
    assert [r.guard_kind for r in checkset.Registry().classify_guards(guards).collect()] == [None, None]
    made = checkset.run_workers(units.select("tu_path").distinct(), lambda p: [{"tu": x} for x in p], "tu string", batch=1)
    assert sorted(r.tu for r in made.collect()) == ["t1", "t2"]
    assert [(r.offset, r.text) for r in rewrite.callback(spark.createDataFrame([("f", "ab")], "file string, text string"), lambda f, t: [(1, 1, f)]).collect()] == [(1, "f")]


def test_checks_as_a_program(spark):
    args = rows(spark, "default_args", [{"qualified_name": "log", "param_index": 1, "default_text": t, "file_path": f, "line": 3} for t, f in (("1", "b.h"), ("2", "a.h"))])
    found = program.run({"default_args": args}, checkset.resolve_checks("all"))
    row = found.first()
    assert (row.check_name, row.call_location) == ("default-arg-divergence", "a.h:3") and "differs: 1 | 2" in row.message
    assert program.run({"default_args": args}, checkset.resolve_checks("-all")) is None
    assert set(program.PROGRAMS) <= set(checkset.CHECKS)


def test_names_and_records(spark):
    nodes = rows(spark, "nodes", [{"usr": "u1", "qualified_name": "f", "is_entry_point": True}, {"usr": "u2", "qualified_name": "g"}])
    assert [(r.name, r.usr) for r in identity.entry_points(nodes, ["g", "u1", "no"]).orderBy("name").collect()] == [("g", "u2"), ("no", None), ("u1", "u1")]
    sites = rows(spark, "call_sites", [{"call_site": "a:1:1", "caller_usr": "x", "try_scopes": [], "guards": [], "raii_locals": []}])
    assert contexts.query_call_site(sites, "a:1:1").first().caller_usr == "x"
    empty = contexts.query_call_site(sites, "b:1:1").first()
    assert (empty.call_site, empty.caller_usr, empty.try_scopes, empty.is_under_try_catch) == ("b:1:1", "", [], False)
    assert scalars.companion("to_usr", "site") == "to_site" and scalars.companion("usr", "filter") == "filter"


def test_path_search_that_grows_too_far_is_an_answer(spark, monkeypatch):
    monkeypatch.setattr(paths, "MOST_PARTIAL", 3)
    wide = [edge("main", f"a{i}") for i in range(6)] + [edge(f"a{i}", f"b{j}") for i in range(6) for j in range(6)] + [edge(f"b{j}", "end") for j in range(6)]
    nodes = [{"usr": u, "qualified_name": u, "is_entry_point": u == "main"} for u in ("main", "end")]
    engine = Engine(spark, {"nodes": rows(spark, "nodes", nodes), "edges": rows(spark, "edges", wide)})
    assert "partial paths" in engine.call("find_call_chain", to_usr="end")["error"]


def test_frames_and_schemas(spark):
    engine = Engine(spark, {"nodes": rows(spark, "nodes", [{"usr": "é", "qualified_name": "é", "is_entry_point": True}])})
    ask = json.dumps({"id": 1, "method": "tools/call", "params": {"name": "lookup_function", "arguments": {"usr": "é"}}}, ensure_ascii=False)
    out = io.StringIO()
    serve(engine, io.StringIO(f"Content-Length: {len(ask.encode())}\r\nX: y\r\n\r\n{ask}" + '{"id": 2, "method": "initialize"}\n{"method": "notified"}\n'), out)
    head, rest = out.getvalue().split("\r\n\r\n", 1)
    body, second = rest[: int(head.split(":")[1])], rest[int(head.split(":")[1]) :]
    assert json.loads(body)["result"]["function"][0]["usr"] == "é" and json.loads(second)["id"] == 2
    found = {t["name"]: t["inputSchema"] for t in schemas()}
    assert found["query_channel"]["required"] == ["channel_id"] and "min_confidence" in found["get_callees"]["properties"]
