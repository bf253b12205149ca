"""Checks, scalars, merging, rewriting and configuration on hand-built rows."""

import json

import pytest
from pyspark.sql import functions as F

from callweave.functions import scalars
from callweave.operators import checks, edges, merge, rewrite
from callweave.plans import checkset
from callweave.plans.schema import rows
from callweave.sources import tables
from callweave.streaming import deltas


def test_static_init_order(spark):
    def s(name, file, refs=(), calls=(), dynamic=True):
        return {"qualified_name": name, "file_path": file, "dynamic_init": dynamic, "referenced_globals": list(refs), "called_functions": list(calls)}

    values = [s("ga", "a"), s("gb", "b", ["ga"]), s("gc", "b", ["gb"]), s("kSafe", "c", dynamic=False), s("gd", "d", ["kSafe"]), s("ge", "e", ["gUnknown"])]
    got = checks.static_init_order(rows(spark, "static_inits", values), rows(spark, "fn_summaries", [])).collect()
    assert [(r.root, r.target, r.chain) for r in got] == [("gb", "ga", "")]
    values = [s("gBase", "base.cpp"), s("gDerived", "derived.cpp", calls=["readBase"])]
    summaries = rows(spark, "fn_summaries", [{"qualified_name": "readBase", "referenced_globals": ["gBase"], "called_functions": []}])
    got = checks.static_init_order(rows(spark, "static_inits", values), summaries).collect()
    assert [(r.root, r.target, r.chain) for r in got] == [("gDerived", "gBase", "readBase")]


def test_exception_escape(spark):
    def f(name, noexcept=False, throws=False, unguarded=()):
        return {"qualified_name": name, "is_noexcept": noexcept, "has_uncaught_throw": throws, "unguarded_calls": list(unguarded), "called_functions": list(unguarded)}

    values = [f("thrower", throws=True), f("mid", unguarded=["thrower"]), f("root", True, unguarded=["mid"]), f("guarded", True), f("selfThrow", True, True)]
    got = {r.root: r.chain for r in checks.exception_escape(rows(spark, "fn_summaries", values)).collect()}
    assert got == {"root": "mid -> thrower", "selfThrow": ""}


def test_hazards(spark):
    s = rows(spark, "static_inits", [{"qualified_name": "g", "dynamic_init": True, "called_functions": ["init"]}, {"qualified_name": "h", "dynamic_init": True, "called_functions": ["calm"]}])
    calls = spark.createDataFrame([("init", "load"), ("load", "dlopen")], "caller string, callee string")
    assert [(r.root, r.target, r.chain) for r in checks.static_init_hazards(s, calls).collect()] == [("g", "dlopen", "init -> load -> dlopen")]


OVERLOADS = {
    "fallback": ([("Core", ["Vector", "int"]), ("Extension", ["Vector", "double"])], ["Vector", "double"], ["Vector", "int"], {}, ["ADL_Fallback"]),
    "resolved is best": ([("Core", ["Vector", "int"]), ("Extension", ["Vector", "double"])], ["Vector", "int"], ["Vector", "int"], {}, []),
    "ambiguous": ([("CoreA", ["Vector", "int", "double"]), ("CoreB", ["Vector", "double", "int"])], ["Vector", "int", "int"], ["Vector", "int", "double"], {}, ["ADL_Ambiguity"]),
    "tie": ([("Core", ["Vector", "int"]), ("Extension", ["Vector", "float"])], ["Vector", "long"], ["Vector", "int"], {"same_score": True}, ["ADL_SameScore"]),
    "no tie asked": ([("Core", ["Vector", "int"]), ("Extension", ["Vector", "float"])], ["Vector", "long"], ["Vector", "int"], {}, []),
    "two ties": ([("A", ["Vector", "int"]), ("B", ["Vector", "float"]), ("C", ["Vector", "unsigned int"])], ["Vector", "long"], ["Vector", "int"], {"same_score": True}, ["ADL_SameScore"] * 2),
    "not viable": ([("A", ["float", "const Vector3 &"]), ("B", ["Matrix", "Matrix"])], ["float", "Vector3"], ["float", "const Vector3 &"], {}, []),
}


@pytest.mark.parametrize("case", OVERLOADS)
def test_adl(spark, case):
    known, args, resolved, options, want = OVERLOADS[case]
    o = rows(spark, "overloads", [{"seq": i, "qualified_name": "f", "header_path": h, "param_types": p} for i, (h, p) in enumerate(known)])
    c = rows(spark, "adl_calls", [{"tu_path": "t", "call_location": "t:1:1", "qualified_name": "f", "resolved_param_types": resolved, "arg_types": args}])
    includes = rows(spark, "tu_includes", [{"tu_path": "t", "file": known[0][0]}])
    assert [r.kind for r in checks.adl(c, o, includes, **options).collect()] == want


def test_adl_conversions(spark):
    o = rows(spark, "overloads", [{"seq": 0, "qualified_name": "route", "header_path": "Core", "param_types": ["int"]}, {"seq": 1, "qualified_name": "route", "header_path": "Imperial", "param_types": ["Mile"]}])
    c = rows(spark, "adl_calls", [{"tu_path": "t", "call_location": "t:1:1", "qualified_name": "route", "resolved_param_types": ["int"], "arg_types": ["double"]}])
    includes = rows(spark, "tu_includes", [{"tu_path": "t", "file": "Core"}])
    known = spark.createDataFrame([("double", "Mile")], "from_type string, to_type string")
    counts = [checks.adl(c, o, includes, **k).count() for k in ({}, {"conversions": known}, {"conversions": known, "same_score": True})]
    assert counts == [0, 0, 1]


def test_visibility(spark):
    v = rows(spark, "ctad_vars", [{"tu_path": "t", "call_location": "x", "template_name": "Box", "deduced_type": "Box<int>"}])
    g = rows(spark, "deduction_guides", [{"template_name": "Box", "header_path": "g.h", "deduced_type": "Box<long>"}])
    assert checks.ctad(v, g, rows(spark, "tu_includes", [])).count() == 1
    assert checks.ctad(v, g, rows(spark, "tu_includes", [{"tu_path": "t", "file": "g.h"}])).count() == 0
    i = rows(spark, "instantiations", [{"tu_path": "t", "template_name": "H", "args_string": "int", "point_of_instantiation": p} for p in ("b", "a")])
    s = rows(spark, "specializations", [{"template_name": "H", "args_string": "int", "header_path": "s.h"}])
    assert [r.at for r in checks.specializations(i, s, rows(spark, "tu_includes", [])).collect()] == ["a"]


def test_odr(spark):
    def o(name, file, h, cls=False, enclosing=""):
        return {"qualified_name": name, "file_path": file, "odr_hash": h, "is_class": cls, "enclosing_class": enclosing}

    values = [o("magic", "m.h", "1"), o("magic", "m.h", "2"), o("dup", "a.h", "10"), o("dup", "b.h", "20"), o("same", "a.h", "7"), o("same", "b.h", "7")]
    values += [o("Cfg", "a.h", "1", True), o("Cfg", "b.h", "2", True), o("Cfg::get", "a.h", "3", enclosing="Cfg"), o("Cfg::get", "b.h", "4", enclosing="Cfg")]
    got = {r.qualified_name: r.kind for r in checks.odr(rows(spark, "odr_entries", values)).collect()}
    assert got == {"magic": "ODR_Divergent", "dup": "ODR_Duplicate", "Cfg": "ODR_Duplicate"}


def test_divergence(spark):
    d = rows(spark, "default_args", [{"qualified_name": "log", "param_index": 1, "default_text": t, "file_path": t} for t in "12"] + [{"qualified_name": "ok", "default_text": "1", "file_path": f} for f in "ab"])
    assert [(r.qualified_name, r.texts) for r in checks.default_args(d).collect()] == [("log", "1 | 2")]
    spec = lambda n, x, f: {"qualified_name": n, "is_noexcept": x, "file_path": f}
    s = rows(spark, "exception_specs", [spec("sdk_init", True, "a"), spec("sdk_init", False, "b"), spec("tune", True, "c"), spec("tune", False, "c"), spec("ok", True, "a"), spec("ok", True, "b")])
    assert {r.qualified_name: r.kind for r in checks.exception_specs(s).collect()} == {"sdk_init": "CrossSite", "tune": "SameSite"}
    h = rows(spark, "header_statics", [{"name": "gCounter", "file_path": "h", "line": 1, "tu_paths": ["a.cpp", "b.cpp", "c.cpp", "d.cpp"]}, {"name": "k", "line": 2, "is_const": True, "tu_paths": ["a", "b"]}, {"name": "one", "line": 3, "tu_paths": ["a"]}])
    assert [(r.name, r.units, r.listed) for r in checks.header_statics(h).collect()] == [("gCounter", 4, "a.cpp, b.cpp, c.cpp, ...")]
    c = rows(spark, "coverage_props", [{"enclosing_class": "MyClass", "signature": n, "gva_linkage": g, "body_stmt_count": b} for n, g, b in (("a", 2, 5), ("b", 2, 25), ("doWork", 4, 5))])
    assert [r.signature for r in checks.coverage_mismatch(c).collect()] == ["doWork"]
    assert [(r.small, r.large, r.pairs) for r in checks.coverage_divergence(c).collect()] == [(1, 1, 1)]


def test_scalars(spark):
    df = spark.createDataFrame([("const std :: vector<int> &&", "a.h:12:7", "x\nyz w")], "t string, l string, b string")
    row = df.select(scalars.normalize_type(F.col("t")).alias("t"), scalars.parse_location(F.col("l")).alias("l"), scalars.line_of(F.col("b"), F.lit(4)).alias("n"), scalars.column_of(F.col("b"), F.lit(4)).alias("c")).first()
    assert row.t == "std::vector<int>" and tuple(row.l) == ("a.h", 12, 7) and (row.n, row.c) == (2, 3)


def edge(tu, **more):
    return {"caller": "a", "callee": "b", "call_site": "s", "tu_path": tu, **more}


def test_refs_and_removal(spark):
    tus = rows(spark, "edge_tus", [edge("a.cpp"), edge("b.cpp")])
    assert [r.refs for r in edges.stored(tus).collect()] == [2]
    one = spark.createDataFrame([("a.cpp",)], "tu_path string")
    left, gone = merge.remove_tus(tus, one)
    assert gone.count() == 0 and edges.stored(left).first().refs == 1
    assert merge.remove_tus(left, spark.createDataFrame([("b.cpp",)], "tu_path string"))[1].count() == 1
    distinct = rows(spark, "edge_tus", [edge("a"), edge("a", confidence="Plausible"), edge("a", kind="LambdaCall"), edge("a", call_site="t")])
    assert edges.stored(distinct).count() == 4


def test_merges(spark):
    a = rows(spark, "nodes", [{"usr": "u", "qualified_name": "first", "file": "old", "line": 3}])
    b = rows(spark, "nodes", [{"usr": "u", "qualified_name": "second", "file": "", "line": 9, "is_virtual": True}])
    assert tuple(merge.absorb("nodes", [a, b]).first()) == ("u", "first", "old", 9, False, True, "")
    s = [rows(spark, "fn_summaries", [{"qualified_name": "f", "file_path": p, "is_noexcept": n, "called_functions": c, "unguarded_calls": [], "referenced_globals": []}]) for p, n, c in (("x", False, ["g", "h"]), ("a", True, ["h", "i"]))]
    row = merge.absorb("fn_summaries", s).first()
    assert (row.file_path, row.is_noexcept, row.called_functions) == ("x", True, ["g", "h", "i"])
    facts = {"edge_tus": rows(spark, "edge_tus", [edge("t1"), edge("t2", call_site="x")])}
    after = merge.apply_delta(facts, "t1", {"edge_tus": rows(spark, "edge_tus", [edge("t1")])})
    assert sorted(map(tuple, after["edge_tus"].collect())) == sorted(map(tuple, facts["edge_tus"].collect()))


def test_journal(spark):
    j = spark.createDataFrame([(1, "a", 5, "try"), (2, "a", 5, "try"), (3, "b", 5, "try"), (4, "b", 5, "done"), (5, "c", 4, "try"), (6, "c", 5, "try")], "seq long, tu_path string, stamp long, state string")
    assert {r.tu_path: r.attempts for r in merge.attempts(j).collect()} == {"a": 2, "b": 0, "c": 1}
    now = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5), ("d", 1)], "tu_path string, stamp long")
    assert {r.tu_path: r.action for r in merge.replayable(j, now).collect()} == {"a": "skip", "b": "reuse", "c": "index", "d": "index"}


def test_snapshot_round_trip(spark, tmp_path):
    g = rows(spark, "edges", [{"caller": "a", "callee": "b"}])
    n = rows(spark, "nodes", [{"usr": "b", "qualified_name": "B"}])
    tables.save_snapshot({"edges": g, "nodes": n}, str(tmp_path / "s"), "cfg")
    assert tables.load_snapshot(spark, str(tmp_path / "s"), "cfg")["edges"].collect() == g.collect()
    assert tables.load_snapshot(spark, str(tmp_path / "s"), "other") is None and tables.load_snapshot(spark, str(tmp_path / "no")) is None
    tables.write_node_tsv(n, g, str(tmp_path / "t"))
    assert [(r.usr, r.callers) for r in tables.read_node_tsv(spark, str(tmp_path / "t")).collect()] == [("b", ["a"])]
    (tmp_path / "c.json").write_text(json.dumps({"totalCallSites": 1, "callSites": [{"caller_name": "x", "call_site": "f:1:2"}]}))
    assert tables.read_call_site_dump(spark, str(tmp_path / "c.json")).first().caller_name == "x"
    for name, arg in (("d1", "one"), ("d2", "two")):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"directory": "/", "file": "a.cpp", "arguments": [arg]}]))
    first = tables.compile_commands(spark, [str(tmp_path / "d1.json"), str(tmp_path / "d2.json")]).collect()
    assert [r.arguments for r in first] == ["one"]
    assert [(r.mtime_ns, r.size) for r in tables.stamp_files(spark, ["/does/not/exist"]).collect()] == [(0, 0)]


def test_templates():
    parts = rewrite.parse_template('A{{x}}B{{y | flatten("&&") | join(" | ")}}C')
    assert [p.text for p in parts if p.name is None] == ["A", "B", "C"]
    assert parts[3].pipes == (("flatten", "&&"), ("join", " | "))
    for bad in ("{{unclosed", "{{}}", "{{ x | }}", '{{ x | join("a" }}'):
        with pytest.raises(ValueError):
            rewrite.parse_template(bad)


def test_rewriting(spark):
    texts = spark.createDataFrame([("a", "CHECK(x && y); old(1); old(2);"), ("b", "nothing"), ("c", "")], "file string, text string")
    spec = {"passes": [{"rules": [{"find": {"matcher": r"CHECK\((?P<c>[^)]*)\)"}, "replace": {"with": '{{ c | flatten("&&") | join("; ") }}'}}, {"find": {"matcher": r"old\((?P<n>\d)\)"}, "replace": {"with": "new({{n}})"}}, {"find": {"matcher": r"ld\("}, "replace": {"with": "LD("}}]}]}
    passes = rewrite.parse_rules(json.dumps(spec))
    assert {r.file: r.new_text for r in rewrite.run(texts, passes).collect()} == {"a": "x; y; new(1); new(2);", "b": "nothing", "c": ""}
    found = rewrite.replacements(texts, passes)
    assert rewrite.accepted(found).where("rejected").count() == 2 and rewrite.conflicts(found).count() == 2
    chained = [rewrite.Pass("1", (rewrite.Rule("old", "mid"),)), rewrite.Pass("2", (rewrite.Rule("mid", "end"),))]
    assert "end(1)" in rewrite.run(texts, chained, chained=True).where("file = 'a'").first().new_text
    assert "mid(1)" in rewrite.run(texts, chained).where("file = 'a'").first().new_text
    spec["passes"][0]["rules"][0]["replace"]["scope"] = "galaxy"
    with pytest.raises(ValueError):
        rewrite.parse_rules(json.dumps(spec))


def test_check_selection(spark):
    assert "dead-code" not in checkset.resolve_checks("all,-dead-code") and len(checkset.resolve_checks("all")) == 12
    assert not checkset.resolve_checks("all,-compute-heavy") & {"odr-violations", "dead-code", "static-init-hazards"}
    assert checkset.resolve_checks("-all,ctad-visibility") == {"ctad-visibility"} and len(checkset.resolve_checks()) == 7
    with pytest.raises(ValueError):
        checkset.resolve_checks("mispelled")
    assert checkset.list_checks(spark).count() == 12


def test_organisation_config():
    text = json.dumps({"lockTypes": ["L", "L"], "featureFlags": [{"pattern": "F(x)", "nameGroup": 1}], "channelTypes": [{"type": "Q", "produce": ["push"]}], "staticInitHazards": ["h"]})
    got = checkset.parse_org_config(text)
    assert got.lock_types == ["L"] and got.flag_patterns == [("F(x)", 1)] and got.channel_types[0]["category"] == "" and got.hazards == ["h"]
    for bad in ({"locktypes": []}, {"featureFlags": [{"pattern": "x", "nameGroup": -1}]}, {"channelTypes": [{}]}):
        with pytest.raises(ValueError):
            checkset.parse_org_config(json.dumps(bad))
    with pytest.raises(ValueError):
        checkset.parse_checks_config('{"checkz": []}')


def test_delta_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batch = lambda v, *rs: rows(spark, "edge_tus", list(rs)).withColumn("version", F.lit(v))
    batch(1, edge("a"), edge("b"), edge("b", call_site="x")).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema.simpleString()[len("struct<") : -1].replace(":", " ")
    deltas.maintain(spark, source, out, str(tmp_path / "cp"), schema).awaitTermination()
    batch(2, edge("b", call_site="y")).write.mode("append").parquet(source)
    deltas.maintain(spark, source, out, str(tmp_path / "cp"), schema).awaitTermination()
    assert {(r.call_site, r.refs) for r in deltas.current_edges(spark, out).collect()} == {("s", 1), ("y", 1)}
