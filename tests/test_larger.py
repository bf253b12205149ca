"""What larger tables showed: work that grew faster than its input, and lists that reached the driver."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from callweave.operators import channels, checks, edges, fixpoint, merge
from callweave.plans import registry
from callweave.plans.schema import rows
from callweave.sources import tables
from callweave.streaming import deltas


def joined_rows(df):
    """The most rows that a join of the executed plan gives, by its metrics."""
    df.write.format("noop").mode("overwrite").save()
    text = df.collect() and df._jdf.queryExecution().executedPlan().finalPhysicalPlan()
    found, todo = [0], [text]
    while todo:
        at = todo.pop()
        if hasattr(at, "plan") and "QueryStage" in at.nodeName():
            todo.append(at.plan())
            continue
        if "Join" in at.nodeName():
            found.append(at.metrics().apply("numOutputRows").value())
        kids = at.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return max(found)


def test_ctad_meets_missing_guides_alone(spark):
    v = rows(spark, "ctad_vars", [{"tu_path": "t", "call_location": f"x:{i}", "template_name": "Box", "deduced_type": "A"} for i in range(40)])
    g = rows(spark, "deduction_guides", [{"template_name": "Box", "header_path": f"g{i % 2}.h", "deduced_type": "B"} for i in range(60)])
    found = checks.ctad(v, g, rows(spark, "tu_includes", [{"tu_path": "t", "file": "g0.h"}]))
    assert {r.missing_header for r in found.collect()} == {"g1.h"} and found.count() == 40
    assert joined_rows(found) <= 40


def test_checks_without_findings_are_counted(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    for path in glob.glob(f"{source}/*.parquet"):
        name = path.rsplit("/", 1)[1]
        df = spark.read.parquet(path)
        (df.limit(0) if name == "lineitem.parquet" else df).write.parquet(f"{tmp_path}/{name}")
    found = {r.check_name: r.n for r in registry.queries()["check_program"](spark, str(tmp_path)).collect()}
    assert len(found) == 6 and found["ctad-visibility"] == 0


def test_refresh_lists_no_files(spark):
    stamps = lambda *found: spark.createDataFrame(list(found), "path string, mtime_ns long, size long")
    old, new = stamps(("a", 1, 1), ("b", 1, 1), ("c", 1, 1)), stamps(("a", 1, 1), ("b", 2, 1), ("d", 1, 1))
    before = {"node_tus": spark.createDataFrame([(f"u{p}", p) for p in "abc"], "usr string, tu_path string")}
    index = lambda paths: {"node_tus": paths.select(F.concat(F.lit("v"), "path").alias("usr"), F.col("path").alias("tu_path"))}
    state, after = merge.refresh(before, old, new, index)
    assert state == "refreshed" and sorted(r.usr for r in after["node_tus"].collect()) == ["ua", "vb", "vd"]
    assert merge.refresh(before, old, old, index) == ("unchanged", before)
    assert merge.refresh(before, old, new, index, same_config=False) == ("rebuild", None)


def test_packed_files_are_few(spark, tmp_path):
    texts = spark.range(0, 500, 1, 2).select(F.concat(F.lit("d"), "id").alias("file"), F.concat(F.lit("a\nLicense"), F.when(F.col("id") % 100 == 0, " under").otherwise(""), F.lit("\n\n")).alias("text"))
    tables.pack_files(texts, f"{tmp_path}/packed")
    assert len(glob.glob(f"{tmp_path}/packed/*")) < 10
    found = tables.packed_with(spark, f"{tmp_path}/packed", "Licensed? under")
    assert sorted(map(tuple, found.collect())) == [(f"d{i}", "a\nLicense under\n\n") for i in range(0, 500, 100)]


def random_graph(spark, seed):
    """Edges with several calls at a place, overrides with several bases and a cycle, deferred returns that meet both."""
    made = random.Random(seed)
    f = lambda: f"f{made.randrange(14)}"
    kinds = [("VirtualDispatch", "Plausible")] * 4 + [("DirectCall", "Proven"), ("VirtualDispatch", "Proven"), ("FunctionPointerReturn", "Proven"), ("FunctionPointerReturn", "Plausible"), ("ConstructorCall", "Proven")]
    rows_ = []
    for _ in range(90):
        kind, sure = made.choice(kinds)
        rows_.append((f"f{made.randrange(5)}", f(), f"s{made.randrange(9)}", kind, sure, made.choice(["Synchronous", "Synchronous", "ThreadSpawn", "AsyncTask"]), made.randrange(2)))
    overrides = {(f"f{i // 2}", f"f{i}") for i in range(2, 12)} | ({("f3", "f9"), ("f4", "f11"), ("f11", "f2")} if seed % 2 else set())
    schema = "caller string, callee string, call_site string, kind string, confidence string, exec_context string, indirection_depth int"
    returns = sorted({(f(), f()) for _ in range(12)})
    return spark.createDataFrame(rows_ + rows_[:20], schema), spark.createDataFrame(sorted(overrides), "base_method string, override_method string"), spark.createDataFrame(returns, "func string, returned_func string")


@pytest.mark.parametrize("seed", range(2))
def test_view_in_parts_is_the_whole_view(spark, seed):
    tus, overrides, returns = random_graph(spark, seed)
    tus, overrides, returns = tus.cache(), overrides.cache(), returns.cache()
    view, whole = edges.View(tus, overrides, returns), fixpoint.cut(edges.expanded(edges.stored(tus), overrides, returns))
    as_rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for by in (("kind", "confidence", "exec_context"), ("caller",), ("callee",)):
        want = whole.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.length("callee")).alias("chars"))
        assert as_rows(view.counts(*by)) == as_rows(want)
    spread_out = view.whole.withColumnRenamed("callee", "base_method").join(view.closed.withColumnRenamed("override_method", "callee"), "base_method").select(*edges.COLUMNS)
    assert as_rows(view.plain.distinct().unionByName(view.deferred).unionByName(view.single).unionByName(spread_out)) == as_rows(whole.select(*edges.COLUMNS))
    sure = edges.EdgeFilter(min_confidence="Proven")
    assert as_rows(view.narrow(sure).distinct()) == as_rows(sure.apply(whole).select(*edges.COLUMNS))
    for target in ("f9",):
        assert as_rows(channels.boundaries_in(view, target)) == as_rows(channels.boundaries(whole, target, most=1 << 60).select(*channels.boundaries_in(view, target).columns))


def test_a_filter_with_dispatch_is_no_narrow_one(spark):
    tus, overrides, returns = random_graph(spark, 0)
    with pytest.raises(ValueError):
        edges.View(tus, overrides, returns).narrow(edges.EdgeFilter(min_confidence="Plausible"))
    assert not edges.EdgeFilter(("LambdaCall",)).dispatch and not edges.EdgeFilter(include_confidences=("Proven",)).dispatch and edges.EdgeFilter().dispatch


def test_tasks_grow_in_number(spark, monkeypatch, tmp_path):
    """Beyond the size of a partition registrations are dealt over more tasks, a unit's too."""
    monkeypatch.setattr(fixpoint, "PART", 1 << 10)
    tus = spark.range(0, 400).select(F.concat(F.lit("f"), "id").alias("caller"), F.lit("g").alias("callee"), F.lit("s").alias("call_site"), F.lit("DirectCall").alias("kind"), F.lit("Proven").alias("confidence"), F.lit("Synchronous").alias("exec_context"), F.lit(0).alias("indirection_depth"), F.lit("t").alias("tu_path"), F.lit(1).alias("version"))
    planned = lambda df: df._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in planned(edges.stored(tus)) and edges.stored(tus).count() == 400
    gone = merge.remove_tus(tus.drop("version"), spark.createDataFrame([("t",)], "tu_path string"))[1]
    assert "REPARTITION_BY_NUM" in planned(gone) and gone.count() == 400
    deltas.apply_batch(tus, f"{tmp_path}/held")
    assert len(glob.glob(f"{tmp_path}/held/tu_path=t/*.parquet")) > 1 and deltas.current_edges(spark, f"{tmp_path}/held").count() == 400
