"""The query tools over one set of fact tables, with their parameters and defaults.

``Engine(spark, tables).call(tool, **args)`` answers with plain dicts and lists; wrong or
missing arguments give ``{"error": ...}``, an ambiguous name gives its candidates.  The
methods themselves return DataFrames.  The expanded edge view is built once and kept
until the tables change.
"""

from __future__ import annotations

import inspect
import json
import sys
from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.operators import channels, contexts, edges, exceptions, identity, liveness, merge, paths, summary
from callweave.operators.fixpoint import cut
from callweave.plans.schema import TABLES, rows

Answer = dict[str, DataFrame]


class AmbiguousName(Exception):
    def __init__(self, found: identity.Ambiguous):
        super().__init__(f"{found.total} candidates")
        self.found = found


class Engine:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark = spark
        self.tables = {name: tables[name] if name in tables else rows(spark, name, []) for name in TABLES}
        self._view: DataFrame | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    @property
    def view(self) -> DataFrame:
        """The expanded edge view."""
        if self._view is None:
            self._view = cut(edges.expanded(self["edges"], self["method_overrides"], self["function_returns"]))
        return self._view

    def _usr(self, name: str = "", usr: str = "", site: str = "", filter: str = "") -> str:
        found = identity.resolve(self["nodes"], self["edges"], self["call_sites"], name, usr, site, filter)
        if isinstance(found, identity.Ambiguous):
            raise AmbiguousName(found)
        return found.usr

    def _starts(self, names: list[str] | None) -> DataFrame:
        """Named functions, each as all it may mean, or the graph's entry points."""
        if not names:
            return self["nodes"].where("is_entry_point").select(F.col("usr").alias("node"))
        found = [identity.candidates(self["nodes"], self["edges"], n) for n in names]
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        return out.select(F.col("usr").alias("node")).distinct()

    @staticmethod
    def _filter(edge_kinds=(), min_confidence="Unknown", include_confidences=None, execution_contexts=()) -> edges.EdgeFilter:
        return edges.EdgeFilter(tuple(edge_kinds), min_confidence, None if include_confidences is None else tuple(include_confidences), tuple(execution_contexts))

    # Functions and edges

    def lookup_function(self, **who) -> Answer:
        usr = self._usr(**who)
        return {"function": self["nodes"].where(F.col("usr") == usr)}

    def get_callees(self, name="", usr="", site="", filter="", **where) -> Answer:
        who = self._usr(name, usr, site, filter)
        found = edges.callees(self["edges"], self["method_overrides"], self["function_returns"], who, self._filter(**where))
        return {"callees": edges.projected(found, self["nodes"])}

    def get_callers(self, name="", usr="", site="", filter="", **where) -> Answer:
        who = self._usr(name, usr, site, filter)
        found = edges.callers(self["edges"], self["method_overrides"], self["function_returns"], who, self._filter(**where))
        return {"callers": edges.projected(found, self["nodes"])}

    def search_functions(self, query: str, limit: int = 25) -> Answer:
        return {"matches": identity.search(self["nodes"], query, limit)}

    def find_call_chain(self, to_name="", to_usr="", to_site="", to_filter="", from_name="", from_usr="", from_site="", from_filter="", max_paths=10, max_depth=20, max_fan_in=1000, **where) -> Answer:
        target = self._usr(to_name, to_usr, to_site, to_filter)
        named = from_name or from_usr or from_site
        starts = self._starts([self._usr(from_name, from_usr, from_site, from_filter)] if named else None)
        kept = self._filter(**where).apply(self.view)
        answer = {"paths": paths.named(paths.find_paths(starts, target, kept, max_depth, max_paths, max_fan_in, self["edges"]), self["nodes"])}
        if max_fan_in:
            answer["skipped_hubs"] = paths.skipped_hubs(starts, target, kept, self["edges"], max_depth, max_fan_in)
        return answer

    # Exceptions, contexts and locks

    def query_exception_safety(self, function="", usr="", site="", filter="", exception_type="", entry_points=None, use_class_hierarchy=False) -> Answer:
        """``use_class_hierarchy``: handlers of bases among the indexed classes count too, not the standard ones alone."""
        target = self._usr(function, usr, site, filter)
        found = cut(paths.find_paths(self._starts(entry_points), target, self.view, max_paths=100))
        more = exceptions.hierarchy(self["derived_classes"]) if use_class_hierarchy else None
        rated = cut(exceptions.protection(found, self["call_sites"], exception_type, more))
        return {"protection": exceptions.verdict(rated, found, function or target, exception_type), "paths": rated}

    def query_throw_propagation(self, **who) -> Answer:
        """The same question from the side of the throw."""
        return self.query_exception_safety(**who)

    def query_all_path_contexts(self, function="", usr="", site="", filter="", entry_points=None) -> Answer:
        target = self._usr(function, usr, site, filter)
        return {"paths": exceptions.path_contexts(paths.find_paths(self._starts(entry_points), target, self.view, max_paths=100), self["call_sites"])}

    def query_nearest_catches(self, function="", usr="", site="", filter="", max_depth=20) -> Answer:
        return {"catches": exceptions.nearest_catches(self._usr(function, usr, site, filter), self.view, self["call_sites"], max_depth)}

    def _context(self, call_site: str, caller: str) -> DataFrame:
        if not self.spark.createDataFrame([(call_site,)], "s string").where(contexts.is_call_site(F.col("s"))).count():
            raise ValueError(f"not file:line:column: {call_site!r}")
        found = contexts.at_site(self["call_sites"], call_site, caller)
        n = len(found.limit(2).collect())
        if not n:
            raise ValueError(f"no context at {call_site}")
        return found

    def query_call_site(self, call_site: str) -> Answer:
        """The first context at a site, or an empty record."""
        return {"context": contexts.query_call_site(self["call_sites"], call_site)}

    def query_call_site_context(self, call_site: str, caller: str = "") -> Answer:
        """Several contexts without a caller are the candidates to choose a caller from."""
        return {"contexts": contexts.described(self._context(call_site, caller)).orderBy("caller_usr")}

    def query_raii_scopes_at_callsite(self, call_site: str, caller: str = "", kinds=()) -> Answer:
        found = contexts.raii_locals(self._context(call_site, caller), tuple(kinds))
        return {"contexts": found.select("call_site", "caller_name", "caller_usr", "callee_name", "locals").orderBy("caller_usr")}

    def _locks(self, target: str, max_depth: int, max_fan_in: int, entry_points) -> DataFrame:
        """``max_depth`` counts functions, so paths have one edge less."""
        real = self.view.where(~F.col("caller").endswith(PLACEHOLDER))
        found = paths.find_paths(self._starts(entry_points), target, real, max_depth - 1, 512, max_fan_in, self["edges"], edge_simple=True)
        return exceptions.locks_on_paths(found, self["call_sites"])

    def query_locks_held(self, name="", usr="", site="", filter="", max_depth=20, max_fan_in=1000, entry_points=None) -> Answer:
        return {"locks": self._locks(self._usr(name, usr, site, filter), max_depth, max_fan_in, entry_points)}

    def query_same_lock(self, fn_a_name="", fn_a_usr="", fn_a_site="", fn_a_filter="", fn_b_name="", fn_b_usr="", fn_b_site="", fn_b_filter="", max_depth=20, max_fan_in=1000, entry_points=None) -> Answer:
        a = self._locks(self._usr(fn_a_name, fn_a_usr, fn_a_site, fn_a_filter), max_depth, max_fan_in, entry_points)
        b = self._locks(self._usr(fn_b_name, fn_b_usr, fn_b_site, fn_b_filter), max_depth, max_fan_in, entry_points)
        return {"locks": exceptions.same_locks(a, b)}

    # Whole graph

    def analyze_dead_code(self, entry_points=None, include_optimistic=True, include_system=False, name_prefix="", file_prefix="", limit=500, offset=0) -> Answer:
        rated = cut(liveness.liveness(self["nodes"], self.view, self._starts(entry_points), self["effective_impls"]))
        answer = {"counts": liveness.counts(rated), "dead": liveness.dead(rated, include_system, name_prefix, file_prefix, limit, offset)}
        if include_optimistic:
            likely = rated.where("verdict = 'optimistic'").withColumn("verdict", F.lit("dead"))
            answer["optimistically_alive"] = liveness.dead(likely, include_system, name_prefix, file_prefix, 1 << 30, 0).drop("verdict")
        return answer

    def get_class_hierarchy(self, class_name: str, include_transitive=False, include_overrides=False) -> Answer:
        derived = summary.derived_classes(self["derived_classes"], include_transitive).where(F.col("base") == class_name)
        answer = {"derived_classes": derived.select("derived")}
        if include_overrides:
            answer["overrides"] = summary.virtual_overrides(self["nodes"], self["method_overrides"], class_name)
        return answer

    def list_entry_points(self, names=None) -> Answer:
        """The graph's entry points, or configured names as far as they are known."""
        return {"entry_points": identity.entry_points(self["nodes"], names)}

    def graph_summary(self) -> Answer:
        return {
            "totals": summary.totals(self["nodes"], self.view, self["call_sites"]),
            "confidence": summary.histogram(self.view, "confidence"),
            "kind": summary.histogram(self.view, "kind"),
            "top_callers": summary.top(self.view, self["nodes"], "caller"),
            "top_callees": summary.top(self.view, self["nodes"], "callee"),
        }

    def list_callback_sites(self, target_prefix="") -> Answer:
        return {"targets": summary.callback_sites(self.view, self["nodes"], target_prefix)}

    def list_concurrency_entry_points(self, execution_contexts=()) -> Answer:
        return {"entries": summary.concurrency_entry_points(self.view, tuple(execution_contexts))}

    # Channels

    def list_channels(self) -> Answer:
        return {"channels": channels.channels(self["channel_sites"])}

    def query_channel(self, channel_id: str) -> Answer:
        found = channels.channel(self["channel_sites"], channel_id)
        if found.isEmpty():
            raise ValueError(f"unknown channel: {channel_id}")
        return {"producers": found.where("op = 'produce'"), "consumers": found.where("op = 'consume'")}

    def query_channels_for_function(self, function: str) -> Answer:
        return {"sites": channels.for_function(self["channel_sites"], function)}

    def explain_ordering(self, call_site_a: str, call_site_b: str) -> Answer:
        sites, above_a, above_b = channels.explain_ordering(self["channel_sites"], self.view, call_site_a, call_site_b)
        return {"sites": sites, "boundaries_a": above_a, "boundaries_b": above_b}

    # Maintenance

    def reindex_tu(self, file: str, facts: dict[str, DataFrame] | None = None) -> Answer:
        """Replace what one unit contributed; ``facts`` are its new rows by table, none if it is gone."""
        removed = merge.apply_delta(self.tables, [file], {})
        counts = [self["edges"].count() - removed["edges"].count(), self["call_sites"].count() - removed["call_sites"].count()]
        changed = merge.apply_delta(self.tables, [file], facts or {})
        # Written, so that a chain of deltas does not grow.
        self.tables = {n: df if df is self.tables[n] else cut(df) for n, df in changed.items()}
        self._view = None
        counts += [self["edges"].count(), self["call_sites"].count()]
        return {"totals": self.spark.createDataFrame([(file, *counts)], "file string, edges_removed long, contexts_removed long, edges_after long, contexts_after long")}

    def call(self, tool: str, /, **args) -> dict:
        """The answer of a tool as plain values."""
        if tool not in TOOLS:
            return {"error": f"unknown tool: {tool}"}
        plain = lambda df: [json.loads(r.value) for r in df.select(F.to_json(F.struct("*")).alias("value")).collect()]
        try:
            return {k: plain(v) for k, v in getattr(self, tool)(**args).items()}
        except AmbiguousName as e:
            found = e.found
            out = {"ambiguous": True, "total": found.total, "truncated": found.truncated, "candidates": plain(found.candidates)}
            return out | ({"by_file": plain(found.by_file)} if found.truncated else {})
        except (TypeError, ValueError) as e:
            return {"error": str(e)}


#: End of the usr of the caller that stands for an unknown one.
PLACEHOLDER = "<indirect>"

# The names of the tools.
TOOLS = (
    "lookup_function",
    "get_callees",
    "get_callers",
    "find_call_chain",
    "search_functions",
    "query_exception_safety",
    "query_call_site_context",
    "query_raii_scopes_at_callsite",
    "query_locks_held",
    "query_same_lock",
    "analyze_dead_code",
    "get_class_hierarchy",
    "list_entry_points",
    "graph_summary",
    "list_callback_sites",
    "list_concurrency_entry_points",
    "list_channels",
    "query_channel",
    "query_channels_for_function",
    "explain_ordering",
    "reindex_tu",
)


def schemas() -> list[dict]:
    """Name, description and input schema of every tool, from its signature."""
    out = []
    for name in TOOLS:
        method = getattr(Engine, name)
        properties, required = {}, []
        for p in list(inspect.signature(method).parameters.values())[1:]:
            if p.kind is p.VAR_KEYWORD:
                own = ("name", "usr", "site", "filter") if p.name == "who" else ("edge_kinds", "min_confidence", "include_confidences", "execution_contexts")
                properties |= {n: {"type": "string" if n in ("name", "usr", "site", "filter", "min_confidence") else "array"} for n in own}
                continue
            kind = type(p.default)
            properties[p.name] = {"type": {bool: "boolean", int: "integer", tuple: "array", type(None): "array"}.get(kind, "string")}
            if p.default is p.empty:
                required.append(p.name)
        text = (method.__doc__ or name.replace("_", " ")).strip().split("\n")[0]
        out.append({"name": name, "description": text, "inputSchema": {"type": "object", "properties": properties, "required": required}})
    return out


def _messages(requests: TextIO) -> Iterator[tuple[str, bool]]:
    """(message, framed): one a line, or as many bytes as a Content-Length header says; told apart message by message."""
    while line := requests.readline():
        if not line.strip():
            continue
        if not line.lower().startswith("content-length:"):
            yield line, False
            continue
        length = int(line.split(":", 1)[1])
        while (line := requests.readline()).strip():
            pass  # other headers
        body = ""
        while len(body.encode()) < length and (c := requests.read(1)):
            body += c
        yield body, True


def serve(engine: Engine, requests: TextIO = sys.stdin, replies: TextIO = sys.stdout) -> None:
    """Answer JSON-RPC requests: initialize, tools/list, and tools/call with name and arguments.

    A reply is framed as its request was; requests without an id get none.
    """
    for message, framed in _messages(requests):
        reply: dict = {"jsonrpc": "2.0", "id": None}
        try:
            request = json.loads(message)
            reply["id"], params, method = request.get("id"), request.get("params", {}), request.get("method")
            if method == "tools/list":
                reply["result"] = {"tools": schemas()}
            elif method == "tools/call":
                reply["result"] = engine.call(params.get("name", ""), **params.get("arguments", {}))
            elif method == "initialize":
                reply["result"] = {"capabilities": {"tools": {}}, "serverInfo": {"name": "callweave"}}
            elif "id" not in request:
                continue
            else:
                reply["error"] = {"code": -32601, "message": f"unknown method: {method}"}
        except json.JSONDecodeError as e:
            reply["error"] = {"code": -32700, "message": str(e)}
        text = json.dumps(reply)
        replies.write(f"Content-Length: {len(text.encode())}\r\n\r\n{text}" if framed else text + "\n")
        replies.flush()
