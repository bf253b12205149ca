"""Cross-unit consistency checks over declaration tables; each gives rows of the diagnostics table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions.scalars import is_arithmetic, linkage_name, normalize_type, signature, strip_pointer
from callweave.operators.fixpoint import closure, cut



def diagnostic(kind: str, check: str, at: Column, message: Column, decl: Column | None = None, better: Column | None = None, header: Column | None = None) -> list[Column]:
    text = lambda c: F.lit("") if c is None else c
    return [
        F.lit(kind).alias("kind"),
        at.alias("call_location"),
        text(decl).alias("resolved_decl"),
        text(better).alias("better_decl"),
        text(header).alias("missing_header"),
        message.alias("message"),
        F.lit(check).alias("check_name"),
    ]


def _site(file: str = "file_path", line: str = "line") -> Column:
    return F.concat(file, F.lit(":"), F.col(line).cast("string"))


def odr(entries: DataFrame) -> DataFrame:
    """(qualified_name, signature, is_class, kind, site): ODR violations, one a group.

    Divergent: some site has two hashes or more (the first such site).  Duplicate:
    several sites and several hashes.  Methods of a class that is Duplicate itself
    are left out.
    """
    key = ["qualified_name", "signature", "is_class"]
    entries = entries.select(*key, "enclosing_class", "file_path", "line", "odr_hash").distinct()
    sites = entries.groupBy(*key, "file_path", "line").agg(F.count_distinct("odr_hash").alias("n"))
    split = sites.groupBy(*key).agg(F.count("*").alias("sites"), F.min(F.when(F.col("n") > 1, F.struct("file_path", "line"))).alias("split"), F.min(F.struct("file_path", "line")).alias("first"))
    hashes = entries.groupBy(*key).agg(F.count_distinct("odr_hash").alias("hashes"), F.max("enclosing_class").alias("class"))
    both = split.join(hashes, key)
    kind = F.when(F.col("split").isNotNull(), "ODR_Divergent").when((F.col("sites") > 1) & (F.col("hashes") > 1), "ODR_Duplicate")
    both = both.withColumn("kind", kind).where("kind is not null")
    flagged = both.where("is_class and kind = 'ODR_Duplicate'").select(F.col("qualified_name").alias("_c")).distinct()
    kept = both.join(flagged, ~F.col("is_class") & (F.col("class") == F.col("_c")), "left_anti")
    at = F.coalesce("split", "first")
    return kept.select(*key, "kind", F.concat(at["file_path"], F.lit(":"), at["line"].cast("string")).alias("site"))


def default_args(rows: DataFrame) -> DataFrame:
    """(qualified_name, signature, param_index, texts): parameters whose default differs between sites."""
    found = rows.groupBy("qualified_name", "signature", "param_index").agg(F.array_sort(F.collect_set("default_text")).alias("t"))
    return found.where(F.size("t") > 1).select("qualified_name", "signature", "param_index", F.array_join("t", " | ").alias("texts"))


def exception_specs(rows: DataFrame) -> DataFrame:
    """(qualified_name, signature, kind, site): functions that are noexcept at some declaration and not at another.

    If one site has both, that site is named, else the first of all.
    """
    key = ["qualified_name", "signature"]
    sites = rows.groupBy(*key, "file_path", "line").agg(F.bool_or("is_noexcept").alias("some"), F.bool_and("is_noexcept").alias("every"))
    found = sites.groupBy(*key).agg(
        F.bool_or("some").alias("some"),
        F.bool_and("every").alias("every"),
        F.min(F.when(F.col("some") & ~F.col("every"), F.struct("file_path", "line"))).alias("both"),
        F.min(F.struct("file_path", "line")).alias("first"),
    )
    at = F.coalesce("both", "first")
    kind = F.when(F.col("both").isNotNull(), "SameSite").otherwise("CrossSite").alias("kind")
    return found.where("some and not every").select(*key, kind, F.concat(at["file_path"], F.lit(":"), at["line"].cast("string")).alias("site"))


def merged_header_statics(rows: DataFrame) -> DataFrame:
    """One row for each (file, line): units united, the first entry's name and constness."""
    lists = rows.select("file_path", "line", "name", "is_const", F.explode("tu_paths").alias("tu"))
    return lists.groupBy("file_path", "line").agg(F.min(F.struct("name", "is_const")).alias("x"), F.collect_set("tu").alias("tus")).select(
        F.col("x.name").alias("name"), "file_path", "line", F.col("x.is_const").alias("is_const"), F.array_sort("tus").alias("tu_paths")
    )


def header_statics(rows: DataFrame) -> DataFrame:
    """(name, file_path, line, units, listed): mutable statics in headers that several units make their own."""
    found = merged_header_statics(rows).where(~F.col("is_const") & (F.size("tu_paths") > 1))
    listed = F.concat(F.array_join(F.slice("tu_paths", 1, 3), ", "), F.when(F.size("tu_paths") > 3, ", ...").otherwise(""))
    return found.select("name", "file_path", "line", F.size("tu_paths").cast("long").alias("units"), listed.alias("listed"))


def coverage_risky(props: DataFrame) -> DataFrame:
    """Functions whose linkage lets their coverage records vanish."""
    kind = F.when(F.col("gva_linkage") == 2, "DiscardableODR").when(F.col("gva_linkage") == 1, "AvailableExternally")
    return props.withColumn("risk", kind).where("risk is not null").select("enclosing_class", "qualified_name", "signature", "risk")


def coverage_mismatch(props: DataFrame) -> DataFrame:
    """(enclosing_class, signature, linkage, majority): methods off their class's most common linkage; ties to the least."""
    cells = props.where("enclosing_class <> ''").groupBy("enclosing_class", "gva_linkage").agg(F.count("*").alias("n"))
    best = cells.groupBy("enclosing_class").agg(F.max_by("gva_linkage", F.struct("n", -F.col("gva_linkage"))).alias("m"), F.sum("n").alias("all"), F.count("*").alias("kinds"))
    best = best.where("all > 1 and kinds > 1").select("enclosing_class", "m")
    return props.join(best, "enclosing_class").where("gva_linkage <> m").select("enclosing_class", "signature", linkage_name(F.col("gva_linkage")).alias("linkage"), linkage_name(F.col("m")).alias("majority"))


def coverage_divergence(props: DataFrame) -> DataFrame:
    """(enclosing_class, gva_linkage, small, large): groups of siblings of which some are small (8 statements or fewer, or trivial) and some not.

    Pairs of such siblings are counted, not made.
    """
    small = (F.col("body_stmt_count") <= 8) | F.col("is_trivial")
    found = props.where("enclosing_class <> ''").groupBy("enclosing_class", "gva_linkage").agg(F.count_if(small).alias("small"), F.count_if(~small).alias("large"))
    return found.where("small > 0 and large > 0").select("enclosing_class", "gva_linkage", "small", "large", (F.col("small") * F.col("large")).alias("pairs"))


def _chains(roots: DataFrame, calls: DataFrame, hits: DataFrame, max_depth: int, stop_at_hit: bool, closed: DataFrame | None = None) -> DataFrame:
    """(root, target, chain) over calls (caller, callee): shortest chains from each root to what ``hits`` (func, target) has.

    ``roots``: (root, start).  Breadth first by root; functions in ``closed`` (func) are
    reached but not left.  With ``stop_at_hit`` a root ends with its first hit.
    """
    calls = cut(calls.select("caller", "callee").distinct())
    frontier = roots.select("root", F.col("start").alias("func")).distinct().withColumn("chain", F.col("func"))
    seen, out, level = cut(frontier.select("root", "func")), None, 0
    while True:
        level += 1
        frontier = cut(frontier)
        if frontier.isEmpty():
            break
        met = frontier.join(hits, "func").select("root", "target", "chain").withColumn("depth", F.lit(level))
        out = met if out is None else out.unionByName(met)
        if level >= max_depth:
            break
        live = frontier
        if stop_at_hit:
            live = live.join(met.select("root").distinct(), "root", "left_anti")
        if closed is not None:
            live = live.join(closed.select("func"), "func", "left_anti")
        step = live.join(calls, F.col("func") == F.col("caller"))
        step = step.groupBy("root", F.col("callee").alias("func")).agg(F.min(F.concat("chain", F.lit(" -> "), F.col("callee"))).alias("chain"))
        frontier = cut(step.join(seen, ["root", "func"], "left_anti"))
        seen = cut(seen.unionByName(frontier.select("root", "func")))
    if out is None:
        return roots.select("root", F.lit("").alias("target"), F.lit("").alias("chain")).limit(0)
    key = ["root"] if stop_at_hit else ["root", "target"]
    best = out.groupBy(*key).agg(F.min(F.struct("depth", "chain", "target")).alias("x"))
    return best.select("root", F.col("x.target").alias("target"), F.col("x.chain").alias("chain"))


def static_init_order(statics: DataFrame, summaries: DataFrame, max_depth: int = 16) -> DataFrame:
    """(root, target, chain): dynamic initialisers that read another file's dynamic global, directly (empty chain) or over calls."""
    firsts = statics.groupBy("qualified_name").agg(F.min(F.struct("seq", "file_path", "dynamic_init")).alias("x"))
    firsts = cut(firsts.select(F.col("qualified_name").alias("target"), F.col("x.file_path").alias("_file"), F.col("x.dynamic_init").alias("_dyn")).where("_dyn"))
    roots = cut(statics.where("dynamic_init and not is_constructor_fn"))
    named = roots.select(F.col("qualified_name").alias("root"), "file_path", "referenced_globals", "called_functions")
    direct = named.select("root", "file_path", F.explode("referenced_globals").alias("target")).withColumn("chain", F.lit(""))
    calls = summaries.select(F.col("qualified_name").alias("caller"), F.explode("called_functions").alias("callee"))
    hits = summaries.select(F.col("qualified_name").alias("func"), F.explode("referenced_globals").alias("target")).distinct()
    far = _chains(named.select("root", F.explode("called_functions").alias("start")), calls, hits.join(firsts.select("target"), "target", "left_semi"), max_depth, False)
    far = far.join(named.select("root", "file_path").distinct(), "root").select("root", "file_path", "target", "chain")
    both = direct.unionByName(far).join(firsts, "target").where("file_path <> _file and root <> target")
    best = both.groupBy("root", "target").agg(F.min(F.struct(F.length("chain").alias("n"), "chain")).alias("x"))
    return best.select("root", "target", F.col("x.chain").alias("chain"))


def exception_escape(summaries: DataFrame, max_depth: int = 16) -> DataFrame:
    """(root, target, chain): noexcept functions that throw (empty chain) or reach a throw over unguarded calls.

    Noexcept functions on the way are not left, but their own throw counts.
    """
    roots = cut(summaries.where("is_noexcept").select(F.col("qualified_name").alias("root"), "has_uncaught_throw", "unguarded_calls"))
    own = roots.where("has_uncaught_throw").select("root", F.col("root").alias("target"), F.lit("").alias("chain"))
    calls = summaries.select(F.col("qualified_name").alias("caller"), F.explode("unguarded_calls").alias("callee"))
    hits = summaries.where("has_uncaught_throw").select(F.col("qualified_name").alias("func"), F.col("qualified_name").alias("target"))
    closed = roots.select(F.col("root").alias("func"))
    starts = roots.where("not has_uncaught_throw").select("root", F.explode("unguarded_calls").alias("start")).where("start <> root")
    return own.unionByName(_chains(starts, calls, hits, max_depth, True, closed))


# Functions that must not run during static initialisation.
HAZARDS = ("dlopen", "dlsym", "dlclose", "dladdr", "pthread_create", "pthread_join", "std::thread::thread", "std::thread::join", "std::async", "std::call_once")


def static_init_hazards(statics: DataFrame, edges: DataFrame, hazards: Iterable[str] = (), max_depth: int = 25) -> DataFrame:
    """(root, target, chain): initialisers that reach a hazard over calls (caller, callee by display name); one each."""
    roots = statics.where(F.col("dynamic_init") & (F.col("is_constructor_fn") | (F.size("called_functions") > 0)))
    own = roots.where("is_constructor_fn").select(F.col("qualified_name").alias("root"), F.col("qualified_name").alias("start"))
    called = roots.select(F.col("qualified_name").alias("root"), F.explode("called_functions").alias("start"))
    names = [*HAZARDS, *hazards]
    hits = statics.sparkSession.createDataFrame([(n, n) for n in names], "func string, target string")
    return _chains(own.union(called), edges, hits, max_depth, True)


def convertible(bases: DataFrame, ctors: DataFrame, conversions: DataFrame) -> DataFrame:
    """(from_type, to_type) of class conversions: derived to base over any number of steps, one constructor, one conversion operator."""
    up = closure(bases, "derived", "base").select(F.col("derived").alias("from_type"), F.col("base").alias("to_type"))
    return up.unionByName(ctors.select("from_type", "to_type")).unionByName(conversions.select("from_type", "to_type")).distinct()


def adl(calls: DataFrame, overloads: DataFrame, includes: DataFrame, same_score: bool = False, conversions: DataFrame | None = None) -> DataFrame:
    """Calls whose overload would be another one, or tie, if a header were included.

    Each position scores 2 for the argument's own type, 1 for the resolved one, for two
    arithmetic types or (with ``conversions``) a conversion, else 0, which rules a
    candidate out.  Fallback: a candidate is better somewhere and worse nowhere;
    ambiguity: each is better somewhere; same score, on request.
    """
    unique = cut(overloads.dropDuplicates(["qualified_name", "header_path", "param_types"]))
    several = unique.groupBy("qualified_name").agg(F.count("*").alias("_n")).where("_n > 1").select("qualified_name")
    pairs = calls.join(several, "qualified_name", "left_semi").join(unique.select("qualified_name", "header_path", "param_types"), "qualified_name")
    pairs = pairs.join(includes.select("tu_path", F.col("file").alias("header_path")), ["tu_path", "header_path"], "left_anti")
    same_arity = (F.size("param_types") == F.size("resolved_param_types")) & (F.size("arg_types") == F.size("param_types"))
    pairs = pairs.where(same_arity & (F.col("param_types") != F.col("resolved_param_types")))
    norm = lambda c: F.transform(c, normalize_type)
    pairs = pairs.select("tu_path", "call_location", "qualified_name", "header_path", "param_types", "resolved_param_types", norm("param_types").alias("p"), norm("resolved_param_types").alias("r"), norm("arg_types").alias("a"))
    zipped = F.posexplode(F.arrays_zip("p", "r", "a")).alias("i", "z")
    key = ["tu_path", "call_location", "qualified_name", "header_path", "param_types", "resolved_param_types"]
    flat = pairs.select(*key, zipped).select(*key, "i", "z.p", "z.r", "z.a")
    bridge = lambda t: F.lit(False)
    if conversions is not None:
        known = conversions.select(F.col("from_type").alias("_f"), F.col("to_type").alias("_t"), F.lit(True).alias("_cp"))
        flat = flat.join(known, (strip_pointer(F.col("a")) == F.col("_f")) & (strip_pointer(F.col("p")) == F.col("_t")), "left").drop("_f", "_t")
        other = known.withColumnRenamed("_cp", "_cr")
        flat = flat.join(other, (strip_pointer(F.col("a")) == F.col("_f")) & (strip_pointer(F.col("r")) == F.col("_t")), "left").drop("_f", "_t")
        bridge = lambda t: F.coalesce(F.col("_cp" if t == "p" else "_cr"), F.lit(False))
    arithmetic = lambda t: is_arithmetic(F.col(t)) & is_arithmetic(F.col("a"))
    score = lambda t: F.when(F.col(t) == F.col("a"), 2).when(F.col(t) == F.col("r"), 1).when(arithmetic(t) | bridge(t), 1).otherwise(0)
    rated = flat.select(*key, "i", score("p").alias("sp"), score("r").alias("sr"))
    found = rated.groupBy(*key).agg(
        F.bool_and((F.col("sp") > 0) & (F.col("sr") > 0)).alias("viable"),
        F.bool_or(F.col("sp") > F.col("sr")).alias("better"),
        F.bool_or(F.col("sp") < F.col("sr")).alias("worse"),
    )
    kind = F.when(F.col("better") & ~F.col("worse"), "ADL_Fallback").when(F.col("better") & F.col("worse"), "ADL_Ambiguity")
    if same_score:
        kind = kind.when(~F.col("better") & ~F.col("worse"), "ADL_SameScore")
    found = found.where("viable").withColumn("kind", kind).where("kind is not null")
    name = F.col("qualified_name")
    return found.select(
        "kind", "call_location", signature(name, F.col("resolved_param_types")).alias("resolved_decl"), signature(name, F.col("param_types")).alias("better_decl"), F.col("header_path").alias("missing_header")
    )


def ctad(variables: DataFrame, guides: DataFrame, includes: DataFrame) -> DataFrame:
    """Variables for which a guide that is not included deduces another type.

    What a unit misses is found for each (unit, template) from distinct guides, so a
    variable meets missing guides alone.
    """
    known = guides.select("template_name", "header_path", F.col("deduced_type").alias("other")).distinct()
    pairs = variables.select("tu_path", "template_name").distinct().join(known, "template_name")
    missing = pairs.join(includes.select("tu_path", F.col("file").alias("header_path")), ["tu_path", "header_path"], "left_anti")
    found = variables.select("tu_path", "call_location", "template_name", "deduced_type").join(cut(missing), ["tu_path", "template_name"]).where("deduced_type <> other")
    return found.select("call_location", "template_name", "deduced_type", "other", F.col("header_path").alias("missing_header")).distinct()


def specializations(instantiations: DataFrame, known: DataFrame, includes: DataFrame) -> DataFrame:
    """(tu_path, template_name, args_string, missing_header, at): instantiations whose explicit specialisation is not included."""
    pairs = instantiations.join(known.select("template_name", "args_string", "header_path").distinct(), ["template_name", "args_string"])
    missing = pairs.join(includes.select("tu_path", F.col("file").alias("header_path")), ["tu_path", "header_path"], "left_anti")
    key = ["tu_path", "template_name", "args_string", "header_path"]
    found = missing.groupBy(*key).agg(F.min("point_of_instantiation").alias("at"))
    return found.select("tu_path", "template_name", "args_string", F.col("header_path").alias("missing_header"), "at")


def as_text(diagnostics: DataFrame) -> DataFrame:
    """``location: message`` lines, in order."""
    return diagnostics.orderBy("call_location", "message").select(F.concat_ws(": ", "call_location", "message").alias("value"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of every key."""
    place = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")
