"""The tools by name, as a client sees them."""

import io
import json

import pytest

from callweave.engine import TOOLS, Engine, serve
from callweave.plans.schema import rows


@pytest.fixture(scope="module")
def engine(spark):
    edge = lambda a, b, **m: {"caller": a, "callee": b, "call_site": f"{a}.cpp:1:1", "tu_path": a, **m}
    tus = [edge("main", "run"), edge("run", "work", kind="LambdaCall"), edge("main", "spawned", kind="ThreadEntry", exec_context="ThreadSpawn")]
    lock = [{"type_name": "mutex", "var_name": "m", "decl_location": "", "kind": "lock"}]
    site = {"caller_usr": "main", "caller_name": "main", "callee_usr": "run", "callee_name": "run", "call_site": "main.cpp:1:1", "raii_locals": lock, "try_scopes": [], "guards": []}
    nodes = [{"usr": u, "qualified_name": u, "is_entry_point": u == "main"} for u in ("main", "run", "work", "spawned", "dead")] + [{"usr": f"d{i}", "qualified_name": "dup"} for i in range(2)]
    channel = {"channel_id": "q", "op": "produce", "function_usr": "work", "function_display": "work", "call_site": "w.cpp:1:1", "guards": []}
    return Engine(spark, {"nodes": rows(spark, "nodes", nodes), "edges": rows(spark, "edges", tus), "edge_tus": rows(spark, "edge_tus", tus), "call_sites": rows(spark, "call_sites", [site]), "channel_sites": rows(spark, "channel_sites", [channel])})


def test_tools(engine):
    assert len(TOOLS) == 21
    assert [c["callee"] for c in engine.call("get_callees", name="run")["callees"]] == ["work"]
    assert [c["caller"] for c in engine.call("get_callers", usr="run", min_confidence="Proven")["callers"]] == ["main"]
    chain = engine.call("find_call_chain", to_name="work")["paths"]
    assert [p["nodes"] for p in chain] == [["main", "run", "work"]]
    assert engine.call("query_locks_held", name="work")["locks"][0]["var_name"] == "m"
    assert engine.call("query_same_lock", fn_a_name="work", fn_b_name="run")["locks"] == [{"type_name": "mutex", "var_name": "m", "on_a": True, "on_b": True}]
    assert {d["qualified_name"] for d in engine.call("analyze_dead_code")["dead"]} == {"dead", "dup"}
    assert engine.call("query_exception_safety", function="work")["protection"][0]["protection"] == "never_caught"
    assert engine.call("query_raii_scopes_at_callsite", call_site="main.cpp:1:1", kinds=["lock"])["contexts"][0]["locals"]
    assert engine.call("graph_summary")["totals"][0]["edge_count"] == 3
    assert len(engine.call("list_concurrency_entry_points")["entries"]) == 1 and len(engine.call("list_callback_sites")["targets"]) == 1
    assert engine.call("query_channel", channel_id="q")["consumers"] == []


def test_errors_are_answers(engine):
    assert engine.call("get_callees", name="dup")["ambiguous"]
    for name, args in (("get_callees", {}), ("nope", {}), ("query_channel", {"channel_id": "x"}), ("query_call_site_context", {"call_site": "bad"}), ("search_functions", {"query": ""}), ("get_callees", {"name": "run", "edge_kinds": ["x"]})):
        assert "error" in engine.call(name, **args)


def test_server(engine):
    lines = [{"id": 1, "method": "tools/list"}, {"id": 2, "method": "tools/call", "params": {"name": "list_entry_points", "arguments": {}}}, {"id": 3, "method": "x"}]
    out = io.StringIO()
    serve(engine, io.StringIO("\n".join(map(json.dumps, lines)) + "\nnot json\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(got[0]["result"]["tools"]) == 21 and got[1]["result"]["entry_points"][0]["usr"] == "main" and "error" in got[2] and "error" in got[3]
