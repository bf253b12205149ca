"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Normalised spellings of the arithmetic types.
ARITHMETIC = (
    "bool",
    "char",
    "signedchar",
    "unsignedchar",
    "wchar_t",
    "char8_t",
    "char16_t",
    "char32_t",
    "short",
    "shortint",
    "unsignedshort",
    "unsignedshortint",
    "int",
    "unsigned",
    "unsignedint",
    "long",
    "longint",
    "unsignedlong",
    "unsignedlongint",
    "longlong",
    "longlongint",
    "unsignedlonglong",
    "unsignedlonglongint",
    "float",
    "double",
    "longdouble",
)


def normalize_type(t: Column) -> Column:
    """Without const and volatile, then without trailing references, then without blanks, in this order."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\b(const|volatile)\b", ""), "&+$", ""), "[ \\t\\n\\r]", "")


def is_arithmetic(normalized: Column) -> Column:
    return normalized.isin(*ARITHMETIC)


def strip_pointer(t: Column) -> Column:
    return F.regexp_replace(t, r"\*$", "")


def signature(name: Column, params: Column) -> Column:
    """name(a, b)"""
    return F.concat(name, F.lit("("), F.array_join(params, ", "), F.lit(")"))


def location(file: Column, line: Column, column: Column) -> Column:
    return F.concat_ws(":", file, line.cast("string"), column.cast("string"))


def parse_location(text: Column) -> Column:
    """struct(file, line, column) of file:line:column; null if it is not one."""
    part = lambda i: F.regexp_extract(text, r"^(.+):([0-9]+):([0-9]+)$", i)
    number = lambda i: part(i).try_cast("int")
    parsed = F.struct(part(1).alias("file"), number(2).alias("line"), number(3).alias("column"))
    return F.when(text.rlike(r"^.+:[0-9]+:[0-9]+$"), parsed)


def linkage_name(gva: Column) -> Column:
    names = ("GVA_Internal", "GVA_AvailableExternally", "GVA_DiscardableODR", "GVA_StrongODR", "GVA_StrongExternal")
    label = F.lit("Unknown")
    for code, name in enumerate(names):
        label = F.when(gva == code, name).otherwise(label)
    return label


def lambda_name(site: Column, enclosing: Column) -> Column:
    """Display name of a lambda: its place, and the function around it or the unit."""
    return F.concat(F.lit("lambda#"), site, F.lit("#"), F.when(F.coalesce(enclosing, F.lit("")) == "", "<tu>").otherwise(enclosing))


def lambda_usr(name: Column) -> Column:
    """Identity of a lambda: its name, which is stable, apart from other identities."""
    return F.concat(F.lit("lambda:"), name)


def template_args(args: Column) -> Column:
    """Template arguments as written at an instantiation and at a specialisation alike: canonical spellings, comma-joined.

    ``args`` are spellings from the fact boundary; blanks are made one, none beside marks.
    """
    canonical = lambda a: F.regexp_replace(F.regexp_replace(F.trim(a), r"\\s+", " "), r" ?([<>,&*]) ?", "$1")
    return F.array_join(F.transform(args, canonical), ", ")


#: Characters and lines of a handler's body, characters of a condition, that facts keep.
BODY, BODY_LINES, CONDITION = 160, 3, 200


def body_summary(text: Column) -> Column:
    """The first lines of a handler's body, cut to ``BODY`` characters."""
    return F.substring(F.array_join(F.slice(F.split(text, "\n"), 1, BODY_LINES), "\n"), 1, BODY)


def condition_text(text: Column) -> Column:
    """A condition, cut to ``CONDITION`` characters."""
    return F.substring(text, 1, CONDITION)


def companion(usr_parameter: str, suffix: str) -> str:
    """The parameter beside an identity's: ``to_usr`` and ``site`` give ``to_site``, ``usr`` gives ``site``."""
    return usr_parameter.removesuffix("usr") + suffix


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n"))


def column_of(text: Column, offset: Column) -> Column:
    """1-based column of a 0-based offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(F.substring_index(before, "\n", -1)) + 1


def content_key(*columns: str) -> Column:
    """An unambiguous key of nested content."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def set_fingerprint(path: str = "path", mtime: str = "mtime_ns", size: str = "size") -> Column:
    """Aggregate: a digest of a set of file stamps, whatever their order."""
    line = F.concat_ws("|", path, F.col(mtime).cast("string"), F.col(size).cast("string"))
    return F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256)
