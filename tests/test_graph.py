"""Graph operators on hand-built relations, and against plain Python on random ones."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from callweave.operators import channels, contexts, edges, exceptions, fixpoint, identity, liveness, paths, summary
from callweave.plans.schema import conform, rows


def e(caller, callee, kind="DirectCall", confidence="Proven", site="", **more):
    return {"caller": caller, "callee": callee, "kind": kind, "confidence": confidence, "call_site": site or f"{caller}>{callee}", **more}


def graph(spark, *values):
    return rows(spark, "edges", list(values))


def nodes(spark, *names, **more):
    return rows(spark, "nodes", [{"usr": n, "qualified_name": n, **more} for n in names])


def starts(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def none(spark, table):
    return rows(spark, table, [])


def verdicts(df):
    return {r.qualified_name: r.verdict for r in df.collect()}


def test_small_liveness(spark):
    g = graph(spark, e("main", "foo"), e("main", "bar", "FunctionPointer", "Plausible"), e("foo", "baz"))
    got = verdicts(liveness.liveness(nodes(spark, "main", "foo", "bar", "baz", "qux"), g, starts(spark, "main"), none(spark, "effective_impls")))
    assert got == {"main": "alive", "foo": "alive", "baz": "alive", "bar": "optimistic", "qux": "dead"}
    page = liveness.dead(liveness.liveness(nodes(spark, "main", "q1", "q2", "q3", file="/usr/lib/x"), g, starts(spark, "main"), none(spark, "effective_impls")), include_system=True, limit=2, offset=1)
    assert [r.qualified_name for r in page.collect()] == ["q2", "q3"]


def test_cascade_liveness(spark):
    g = graph(spark, e("main", "A"), e("A", "B", "FunctionPointer", "Plausible"), e("B", "C"))
    got = verdicts(liveness.liveness(nodes(spark, "main", "A", "B", "C"), g, starts(spark, "main"), none(spark, "effective_impls")))
    assert got == {"main": "alive", "A": "alive", "B": "optimistic", "C": "optimistic"}


def test_dispatch_needs_a_constructed_class(spark):
    g = graph(spark, e("main", "I::run", "VirtualDispatch", "Plausible"), e("main", "J::run", "VirtualDispatch", "Plausible"), e("main", "f"), e("f", "I::I", "ConstructorCall"), e("I::run", "g"))
    n = rows(spark, "nodes", [{"usr": u, "qualified_name": u, "enclosing_class": c} for u, c in (("main", ""), ("f", ""), ("g", ""), ("I::run", "I"), ("I::I", "I"), ("J::run", "J"))])
    got = verdicts(liveness.liveness(n, g, starts(spark, "main"), none(spark, "effective_impls")))
    assert (got["I::run"], got["g"], got["J::run"]) == ("optimistic", "optimistic", "dead")


def test_deferred_returns(spark):
    g = graph(spark, e("driver", "pick", "FunctionPointerReturn", indirection_depth=2), e("driver", "pick"))
    r = rows(spark, "function_returns", [{"func": "pick", "returned_func": f} for f in ("fa", "fb")])
    o = none(spark, "method_overrides")
    got = {(x.callee, x.kind) for x in edges.callees(g, o, r, "driver").collect()}
    assert got == {("pick", "DirectCall"), ("fa", "FunctionPointer"), ("fb", "FunctionPointer")}
    assert [x.caller for x in edges.callers(g, o, r, "fa").collect()] == ["driver"]
    assert [x.kind for x in edges.callers(g, o, r, "pick").collect()] == ["DirectCall"]
    assert edges.callees(g, o, r.limit(0), "driver").count() == 1
    spawned = graph(spark, e("driver", "pick", "FunctionPointerReturn", exec_context="ThreadSpawn"))
    assert {x.kind for x in edges.callees(spawned, o, r, "driver").collect()} == {"ThreadEntry"}


def test_override_expansion(spark):
    g = graph(spark, e("caller", "Base::run", "VirtualDispatch", "Plausible", "a.cpp:2:3"))
    chain = [("Base::run", "Mid::run"), ("Mid::run", "Leaf::run")]
    o = rows(spark, "method_overrides", [{"base_method": a, "override_method": b} for a, b in chain])
    r = none(spark, "function_returns")
    assert edges.callees(g, o, r, "caller").count() == 3 and g.count() == 1
    assert [x.caller for x in edges.callers(g, o, r, "Leaf::run").collect()] == ["caller"]
    proven = graph(spark, e("caller", "Base::run", "VirtualDispatch"))
    assert edges.callees(proven, o, r, "caller").count() == 1
    both = g.unionByName(graph(spark, e("caller", "Mid::run", site="a.cpp:2:3")))
    assert sorted(x.callee for x in edges.callees(both, o, r, "caller").collect()) == ["Base::run", "Leaf::run", "Mid::run"]


def test_edge_filters_are_strict(spark):
    g = graph(spark, e("a", "b"), e("a", "c", "LambdaCall", "Plausible"), e("a", "d", confidence="Unknown"))
    assert edges.EdgeFilter(min_confidence="Plausible").apply(g).count() == 2
    assert edges.EdgeFilter(include_confidences=()).apply(g).count() == 0
    assert edges.EdgeFilter(("LambdaCall",)).apply(g).count() == 1
    for bad in ({"edge_kinds": ("Nope",)}, {"min_confidence": "x"}, {"execution_contexts": ("y",)}):
        with pytest.raises(ValueError):
            edges.EdgeFilter(**bad)


F4 = [("main", "processFile", "main.cpp:5:3"), ("main", "directAlloc", "main.cpp:6:3"), ("processFile", "readChunk", "proc.cpp:10:5"), ("readChunk", "allocateBuffer", "read.cpp:5:5"), ("directAlloc", "allocateBuffer", "direct.cpp:3:5")]


def contexts_of(spark, caught="std::exception", catch_all=False, at="proc.cpp:10:5"):
    handler = [{"caught_type": caught, "is_catch_all": catch_all, "location": "", "body_summary": ""}]
    scope = [{"try_location": "proc.cpp:8:3", "enclosing_function": "", "nesting_depth": 0, "handlers": handler}]
    return rows(spark, "call_sites", [{"seq": i, "caller_usr": a, "callee_usr": b, "caller_name": a, "callee_name": b, "call_site": s, "try_scopes": scope if s == at else [], "guards": [], "raii_locals": []} for i, (a, b, s) in enumerate(F4)])


@pytest.mark.parametrize(
    ("exception", "caught", "catch_all", "want"),
    [("std::bad_alloc", "std::exception", False, "sometimes_caught"), ("int", "...", True, "sometimes_caught"), ("std::out_of_range", "std::runtime_error", False, "never_caught"), ("std::out_of_range", "const std::logic_error &", False, "sometimes_caught")],
)
def test_exception_protection(spark, exception, caught, catch_all, want):
    g = graph(spark, *[e(a, b, site=s) for a, b, s in F4])
    found = paths.find_paths(starts(spark, "main"), "allocateBuffer", g)
    assert found.count() == 2
    row = exceptions.verdict(exceptions.protection(found, contexts_of(spark, caught, catch_all), exception)).first()
    assert (row.protection, row.total_paths) == (want, 2)


def test_exception_corner_verdicts(spark):
    g = graph(spark, *[e(a, b, site=s) for a, b, s in F4])
    empty = paths.find_paths(starts(spark, "nowhere"), "allocateBuffer", g)
    assert exceptions.verdict(exceptions.protection(empty, contexts_of(spark))).first().protection == "unknown"
    near = exceptions.nearest_catches("allocateBuffer", g, contexts_of(spark)).collect()
    assert [(r.caller, r.frames) for r in near] == [("processFile", 2)]
    assert exceptions.bases("std::filesystem::filesystem_error") == ["std::filesystem::filesystem_error", "std::system_error", "std::runtime_error", "std::exception"]


def lock(name):
    return [{"type_name": "std::lock_guard<std::mutex>", "var_name": name, "decl_location": "", "kind": "lock"}]


def test_locks(spark):
    g = graph(spark, e("entry", "mid", site="entry.cpp:3:3"), e("mid", "leaf", site="mid.cpp:2:3"))
    c = rows(spark, "call_sites", [{"caller_usr": "entry", "callee_usr": "mid", "call_site": "entry.cpp:3:3", "raii_locals": lock("g")}, {"caller_usr": "mid", "callee_usr": "leaf", "call_site": "mid.cpp:2:3", "raii_locals": []}])
    found = exceptions.locks_on_paths(paths.find_paths(starts(spark, "entry"), "leaf", g, edge_simple=True), c).collect()
    assert [(r.entry, r.nodes, r.var_name, r.held_at) for r in found] == [("entry", ["entry", "mid", "leaf"], "g", "entry.cpp:3:3")]
    assert paths.find_paths(starts(spark, "entry"), "leaf", g, max_depth=1).count() == 0
    same = exceptions.same_locks(*[spark.createDataFrame([("t", v)], "type_name string, var_name string") for v in ("ga", "gb")])
    assert same.where("on_a and on_b").count() == 0


def test_channels(spark):
    site = lambda op, f: {"channel_id": "c:eventQueue_", "op": op, "function_usr": f, "function_display": f, "call_site": f"{f}:1:1", "guards": [], "tu_path": "a"}
    tus = rows(spark, "channel_site_tus", [site("produce", "A::send"), site("produce", "B::send"), site("consume", "X::drain"), site("consume", "Y::drain"), site("produce", "A::send") | {"tu_path": "b"}])
    counted = channels.counted(tus)
    row = channels.channels(counted).first()
    assert (row.producers, row.consumers, counted.count()) == (2, 2, 4)
    assert channels.for_function(counted, "A::send").first().refs == 2
    g = graph(spark, e("m", "t", "ThreadEntry", exec_context="ThreadSpawn"), e("t", "A::send"), e("x", "m"))
    assert [(r.caller, r.callee) for r in channels.boundaries(g, "A::send").collect()] == [("m", "t")]


def test_identity(spark):
    n = rows(spark, "nodes", [{"usr": f"u{i:02}", "qualified_name": "big::process", "file": f"f{i % 3}.cpp"} for i in range(30)] + [{"usr": "v", "qualified_name": "one"}])
    g = graph(spark, e("u01", "ghost"))
    many = identity.resolve(n, g, name="big::process")
    assert isinstance(many, identity.Ambiguous) and many.total == 30 and many.truncated and many.candidates.count() == 25
    assert sum(r.n for r in many.by_file.collect()) == 30
    assert identity.resolve(n, g, name="big::process", narrow="u07") == identity.Resolved("u07")
    assert identity.resolve(n, g, name="one") == identity.Resolved("v") and identity.resolve(n, g, name="ghost") == identity.Resolved("ghost")
    with pytest.raises(ValueError):
        identity.resolve(n, g, name="nobody")
    top = identity.search(n, "PROCESS", 2).collect()
    assert [(r.usr, r.tier, r.total_matches) for r in top] == [("u00", 0, 30), ("u01", 0, 30)]


def test_tool_graph_summary(spark):
    n = nodes(spark, "main", "processFile", "readData", "writeLog", "cleanup", "Base::doWork", "Derived::doWork", "orphanFunc")
    g = graph(spark, e("main", "processFile"), e("main", "writeLog", confidence="Plausible"), e("processFile", "readData"), e("main", "cleanup"), e("main", "Base::doWork", "VirtualDispatch", "Plausible"))
    o = rows(spark, "method_overrides", [{"base_method": "Base::doWork", "override_method": "Derived::doWork"}])
    view = edges.expanded(g, o, none(spark, "function_returns"))
    assert {r.confidence: r.n for r in summary.histogram(view, "confidence").collect()} == {"Proven": 3, "Plausible": 3, "Unknown": 0}
    kinds = {r.kind: r.n for r in summary.histogram(view, "kind").collect()}
    assert (kinds["DirectCall"], kinds["VirtualDispatch"], len(kinds)) == (4, 2, 9)
    total = summary.totals(n, view, none(spark, "call_sites")).first()
    assert (total.node_count, total.edge_count) == (8, 6)


def test_paths_against_brute_force(spark):
    made = random.Random(9)
    pairs = sorted({(f"n{made.randint(0, 11)}", f"n{made.randint(0, 11)}") for _ in range(44)})
    g = graph(spark, *[e(a, b) for a, b in pairs])
    got = [tuple(r.nodes) for r in paths.find_paths(starts(spark, "n0", "n1"), "n7", g, max_depth=5, max_paths=1000).orderBy("rank").collect()]
    want, queue = [], deque([("n7",)])
    while queue:
        p = queue.popleft()
        if p[0] in ("n0", "n1"):
            want.append(p)
        elif len(p) <= 5:
            queue.extend((a, *p) for a, b in pairs if b == p[0] and a not in p)
    assert got == sorted(want, key=lambda p: (len(p), p)) and len(got) > 3
    assert paths.find_paths(starts(spark, "n7"), "n7", g).first().length == 0


def test_hub_cut_off(spark):
    g = graph(spark, *[e(f"c{i}", "hub") for i in range(5)], e("hub", "t"), e("c0", "t"))
    assert paths.find_paths(starts(spark, "c0", "c1"), "t", g).count() == 3
    assert paths.find_paths(starts(spark, "c0", "c1"), "t", g, max_fan_in=3).count() == 1
    assert [r.node for r in paths.skipped_hubs(starts(spark, "c0"), "t", g, g, 5, 3).collect()] == ["hub"]


def test_fixpoints_against_brute_force(spark):
    made = random.Random(11)
    pairs = sorted({(made.randint(0, 40), made.randint(0, 40)) for _ in range(60)})
    df = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string")
    after = {}
    for a in {p[0] for p in pairs}:
        dist, queue = {a: 0}, deque([a])
        while queue:
            x = queue.popleft()
            for s, d in pairs:
                if s == x and d not in dist:
                    dist[d] = dist[x] + 1
                    queue.append(d)
        after[a] = dist
    got = {(int(r.src), int(r.dst)) for r in fixpoint.closure(df, "src", "dst").collect()}
    assert got == {(a, b) for a, d in after.items() for b in d if a != b}
    root = pairs[0][0]
    assert {int(r.node): r.dist for r in fixpoint.min_dist(starts(spark, str(root)), df).collect()} == after[root]


def test_contexts(spark):
    c = contexts_of(spark)
    assert contexts.protected_calls(c).count() == 1 and contexts.unprotected_calls(c).count() == 4
    assert contexts.described(contexts.at_site(c, "proc.cpp:10:5")).first().is_under_try_catch
    assert contexts.for_function(c, "allocateBuffer").count() == 2
    text = contexts.dump(c.where("call_site = 'read.cpp:5:5'")).first().value
    assert "try_scopes" not in text and "readChunk" in text
    with pytest.raises(ValueError):
        contexts.raii_locals(c, ("mutex",))
    flags = spark.createDataFrame([("FFlag::Foo && x",), ("DFFlagBar",), ("none",)], "condition_text string")
    got = [r.flag for r in contexts.feature_flags(flags, "condition_text", [(r"FFlag::(\w+)", 1), (r"DFFlag\w+", 3)]).collect()]
    assert got == ["Foo", "DFFlagBar", None]


def test_collapse(spark):
    n = rows(spark, "nodes", [{"usr": "a", "file": "/x/third_party/a.cpp"}, {"usr": "b", "file": "third_party/b.cpp"}, {"usr": "c", "file": "/x/not_third_party/c.cpp"}])
    g = graph(spark, e("a", "b"), e("a", "c"), e("c", "zz"))
    assert edges.collapsed(g, n, ["third_party/"]).count() == 3
    n = n.withColumn("file", F.regexp_replace("file", "^third_party", "/third_party"))
    assert edges.collapsed(g, n, ["third_party/"]).count() == 2
    assert conform(g.select("caller", "callee"), "edges").first().confidence == "Proven"
    assert edges.skip_paths(n, "file", ["third_party"]).select(F.col("usr")).first().usr == "c"
