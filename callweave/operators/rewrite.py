"""Rule-driven rewriting: templates, replacements, conflicts and application.

Rules match regular expressions with named groups over a table of texts (file, text);
a syntax-aware producer can supply the match table instead: (file, offset, length,
bindings).  Every pass matches the original text unless ``chained`` is asked for.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.operators.fixpoint import cut

_PIPE = re.compile(r'\s*(\w+)\s*(?:\(\s*"((?:[^"\\]|\\.)*)"\s*\))?\s*')


@dataclass(frozen=True)
class Part:
    """A literal (``name`` is None) or an expression with its pipe operations."""

    name: str | None
    text: str = ""
    pipes: tuple[tuple[str, str | None], ...] = ()


def parse_template(source: str) -> list[Part]:
    """``A{{x | op("arg") | op}}B`` as parts; bars inside quotes are literal.

    Unclosed braces and parentheses, empty names and empty pipes are ``ValueError``.
    """
    parts, at = [], 0
    while (start := source.find("{{", at)) >= 0:
        end = source.find("}}", start)
        if end < 0:
            raise ValueError(f"unclosed {{{{ in template: {source}")
        if start > at:
            parts.append(Part(None, source[at:start]))
        pieces, quoted, last = [], False, start + 2
        for i in range(start + 2, end):
            quoted ^= source[i] == '"'
            if source[i] == "|" and not quoted:
                pieces.append(source[last:i])
                last = i + 1
        pieces.append(source[last:end])
        name = pieces[0].strip()
        if not name:
            raise ValueError(f"empty name in template: {source}")
        pipes = []
        for piece in pieces[1:]:
            if not piece.strip():
                raise ValueError(f"empty pipe in template: {source}")
            if not (m := _PIPE.fullmatch(piece)):
                raise ValueError(f"malformed pipe {piece.strip()!r} in template: {source}")
            pipes.append((m[1], None if m[2] is None else re.sub(r"\\(.)", r"\1", m[2])))
        parts.append(Part(name, "", tuple(pipes)))
        at = end + 2
    if at < len(source):
        parts.append(Part(None, source[at:]))
    return parts


# Binary operators by precedence, the loosest first; all but assignments group to the left.
_BINARY = (
    (",",),
    ("=", "+=", "-=", "*=", "/=", "%=", "<<=", ">>=", "&=", "^=", "|="),
    ("?",),
    ("||",),
    ("&&",),
    ("|",),
    ("^",),
    ("&",),
    ("==", "!="),
    ("<", ">", "<=", ">="),
    ("<=>",),
    ("<<", ">>"),
    ("+", "-"),
    ("*", "/", "%"),
)
_LEVEL = {op: i for i, ops in enumerate(_BINARY) for op in ops}
_TOKEN = re.compile(r'''"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|->\*?|\.\*|\+\+|--|::|<=>|<<=|>>=|[-+*/%&|^=!<>]=|&&|\|\||<<|>>|\w+|\s+|.''', re.S)


def _operators(text: str) -> list[tuple[int, int, str]]:
    """(start, end, operator) of the binary operators outside brackets and quotes."""
    out, depth, operand = [], 0, False
    for m in _TOKEN.finditer(text):
        t = m[0]
        if t.isspace():
            continue
        if t in "([{":
            depth, operand = depth + 1, False
        elif t in ")]}":
            depth, operand = depth - 1, True
        elif depth == 0 and operand and t in _LEVEL:
            out.append((m.start(), m.end(), t))
            operand = False
        else:
            operand = t not in _LEVEL and t not in ("!", "~", ":", "->", ".", "::", "->*", ".*")
    return out


def flatten(text: str, op: str) -> list[str]:
    """Operands of a chain of one binary operator, left to right; whatever binds otherwise, or stands in brackets, is one operand."""
    found = _operators(text)
    parts, end = [], len(text)
    while found:
        loosest = min(_LEVEL[o] for _, _, o in found)
        at = max(i for i, (_, _, o) in enumerate(found) if _LEVEL[o] == loosest)
        start, after, last = found[at]
        if last != op:
            break
        parts.append(text[after:end].strip())
        found, end = found[:at], start
    return [text[:end].strip(), *reversed(parts)]


def _flatten(value: Column, op: str) -> Column:
    import pandas as pd

    return F.pandas_udf(lambda texts: pd.Series([flatten(t or "", op) for t in texts], dtype=object), "array<string>")(value)


def compile_template(source: str, bindings: str = "bindings") -> Column:
    """The template as a column over a map of bindings.

    ``text`` is the binding itself, ``name`` its last identifier; ``flatten("op")``
    splits a chain of one operator into a list, which ``join("sep")`` puts together; a
    list that is not joined is concatenated.
    """
    out = []
    for part in parse_template(source):
        if part.name is None:
            out.append(F.lit(part.text))
            continue
        value, is_list = F.coalesce(F.element_at(F.col(bindings), part.name), F.lit("")), False
        for i, (op, arg) in enumerate(part.pipes):
            if op in ("text", "name", "flatten") and i:
                raise ValueError(f"{op} must come first in: {source}")
            if op == "name":
                value = F.regexp_extract(value, r"([A-Za-z_]\w*)\W*$", 1)
            elif op == "flatten":
                value, is_list = _flatten(value, arg or ""), True
            elif op == "join":
                if not is_list:
                    raise ValueError(f"join needs a list in: {source}")
                value, is_list = F.array_join(value, arg or ""), False
            elif op != "text":
                raise ValueError(f"unknown operation {op!r} in: {source}")
        out.append(F.array_join(value, "") if is_list else value)
    return F.concat(*out) if out else F.lit("")


SCOPES = ("node", "macro-expansion")


@dataclass(frozen=True)
class Rule:
    """Find a pattern (in texts that also have the pass's context) and replace one group, or the whole match."""

    pattern: str
    template: str
    target: str = ""
    context: str = ""
    scope: str = "node"
    macro_names: tuple[str, ...] = ()
    arg_only: bool = False


@dataclass(frozen=True)
class Pass:
    name: str
    rules: tuple[Rule, ...] = field(default_factory=tuple)


def parse_rules(text: str) -> list[Pass]:
    """Passes from JSON: passes[].{name, context, rules[].{find.matcher, replace.{target, with, scope, macro-names, arg-only}}}."""
    passes = []
    for p in json.loads(text)["passes"]:
        rules = []
        for r in p["rules"]:
            replace = r["replace"]
            scope = replace.get("scope", "node")
            if scope not in SCOPES:
                raise ValueError(f"unknown scope {scope!r}")
            parse_template(replace["with"])
            rules.append(
                Rule(r["find"]["matcher"], replace["with"], replace.get("target", ""), p.get("context", ""), scope, tuple(replace.get("macro-names", ())), bool(replace.get("arg-only", False)))
            )
        passes.append(Pass(p.get("name", ""), tuple(rules)))
    return passes


def matches(texts: DataFrame, rule: Rule, ordinal: int = 0) -> DataFrame:
    """(rule, file, offset, length, bindings) of every match, by an Arrow-batched scan of whole texts."""
    import pyarrow as pa

    pattern, context, target = re.compile(rule.pattern), re.compile(rule.context) if rule.context else None, rule.target
    schema = "rule int, file string, offset int, length int, bindings map<string,string>"

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("rule", "file", "offset", "length", "bindings")}
            for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if context is not None and not context.search(text):
                    continue
                for m in pattern.finditer(text):
                    a, b = m.span(target or 0)
                    if a >= 0:
                        bound = {k: v for k, v in m.groupdict().items() if v is not None} | {"root": m[0]}
                        for c, v in zip(out, (ordinal, file, a, b - a, list(bound.items())), strict=True):
                            out[c].append(v)
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return texts.select("file", "text").where("text is not null").mapInArrow(run, schema)


def macro_filter(found: DataFrame, rule: Rule) -> DataFrame:
    """For match tables with macro columns: keep arguments of the named macros, whole arguments only if asked."""
    if rule.scope != "macro-expansion":
        return found
    keep = F.col("is_macro_arg")
    keep = keep & F.col("macro_name").isin(*rule.macro_names) if rule.macro_names else keep
    return found.where(keep & F.col("is_whole_arg") if rule.arg_only else keep)


def from_matches(found: DataFrame, rule: Rule, ordinal: int = 0) -> DataFrame:
    """(rule, file, offset, length, text) for a match table that a syntax-aware producer supplies: (file, offset, length, bindings, macro columns)."""
    kept = macro_filter(found, rule)
    return kept.select(F.lit(ordinal).alias("rule"), "file", "offset", "length", compile_template(rule.template).alias("text"))


def callback(texts: DataFrame, produce: Callable[[str, str], list[tuple[int, int, str]]], ordinal: int = 0) -> DataFrame:
    """(rule, file, offset, length, text) that ``produce`` asks for on each whole (file, text)."""
    import pyarrow as pa

    names = ["rule", "file", "offset", "length", "text"]
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = [
                (ordinal, file, *made)
                for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True)
                for made in produce(file, text)
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    schema = "rule int, file string, offset int, length int, text string"
    return texts.select("file", "text").where("text is not null").mapInArrow(run, schema)


def replacements(texts: DataFrame, passes: list[Pass]) -> DataFrame:
    """(rule, file, offset, length, text) that the passes ask for on the original texts; equal ones once."""
    found, n = None, 0
    for p in passes:
        for rule in p.rules:
            rows = matches(texts, rule, n).withColumn("text", compile_template(rule.template)).drop("bindings")
            found = rows if found is None else found.unionByName(rows)
            n += 1
    if found is None:
        return texts.sparkSession.createDataFrame([], "rule int, file string, offset int, length int, text string")
    return found.groupBy("file", "offset", "length", "text").agg(F.min("rule").alias("rule"))


def accepted(found: DataFrame) -> DataFrame:
    """Adds ``rejected``: replacements of a file are taken by rule, then offset, and one that overlaps a taken one is refused."""
    item = F.struct("rule", "offset", "length", "text")
    lists = found.groupBy("file").agg(F.array_sort(F.collect_list(item)).alias("x"))

    def step(done, y):
        clash = F.exists(done, lambda z: ~z["rejected"] & (z["offset"] < y["offset"] + F.greatest(y["length"], F.lit(1))) & (y["offset"] < z["offset"] + F.greatest(z["length"], F.lit(1))))
        return F.concat(done, F.array(F.struct(*[y[c].alias(c) for c in ("rule", "offset", "length", "text")], clash.alias("rejected"))))

    start = F.array().cast("array<struct<rule:int,offset:int,length:int,text:string,rejected:boolean>>")
    return lists.select("file", F.explode(F.aggregate("x", start, step)).alias("y")).select("file", "y.*")


def conflicts(found: DataFrame) -> DataFrame:
    """Replacements that overlap the one before them in their file."""
    before = Window.partitionBy("file").orderBy("offset", "length", "text").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.max(F.col("offset") + F.col("length")).over(before)
    return found.withColumn("_upto", upto).where("_upto > offset").drop("_upto")


def apply(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(file, new_text) of every text, with its accepted replacements made."""
    taken = accepted(found).where("not rejected")
    lists = taken.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "text"))).alias("x"))
    both = texts.select("file", F.col("text").alias("old")).join(lists, "file", "left")

    def step(acc, y):
        kept = F.substring(F.col("old"), acc["at"] + 1, y["offset"] - acc["at"])
        return F.struct(F.concat(acc["out"], kept, y["text"]).alias("out"), (y["offset"] + y["length"]).alias("at"))

    end = F.aggregate("x", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
    made = F.concat(end["out"], F.substring(F.col("old"), end["at"] + 1, F.length("old")))
    return both.select("file", F.when(F.col("x").isNull(), F.col("old")).otherwise(made).alias("new_text"))


def run(texts: DataFrame, passes: list[Pass], chained: bool = False) -> DataFrame:
    """All passes: on the original texts, or one after the other if ``chained``."""
    if not chained:
        return apply(texts, replacements(texts, passes))
    for p in passes:
        texts = cut(apply(texts, replacements(texts, [p])).withColumnRenamed("new_text", "text"))
    return texts.withColumnRenamed("text", "new_text")
