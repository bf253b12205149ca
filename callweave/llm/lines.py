"""Line dedup: lines that spread over many distinct sites are boilerplate.

The spread of a line is the number of distinct sources it occurs on, whatever the
texts it stands in.  Lines are hashed once to a narrow table, from which

1. HyperLogLog sketches of the sites of each line hash are built beside the rows and
   merge by aggregation, with bounded memory however many rows or sites a line has;
2. lines whose estimate is further from the threshold than the sketch's error are
   decided by it;
3. the others get exact distinct counts.

Every line at the threshold goes from every document, whatever share of it that is.

A line is keyed by 96 bits of hash.  Key tables meet the line table by broadcast while
they have at most ``MOST_BROADCAST`` rows, else by a join that deals each key over
``SALTS`` tasks, so a line that a third of all documents have is no single task's.
DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import BLANKS, cut, packed, unpacked

#: A line on so many sites is boilerplate; shorter lines than so many words, or lines of fewer distinct texts, never are.
SITES, MIN_WORDS, MIN_TEXTS = 4, 1, 1
#: log2 of a sketch's registers, and six standard errors of its estimate.
LG_K = 11
MARGIN = 6 * 1.04 / (1 << LG_K) ** 0.5
#: Keys (12 bytes each) that are broadcast at most, and parts of each key beyond that.
MOST_BROADCAST, SALTS = 1_000_000, 64

_TRIM = f"^[{BLANKS}]+|[{BLANKS}]+$"


def _long_enough(line: Column, words: int) -> Column:
    return line.rlike(rf"(?:[^{BLANKS}]+[{BLANKS}]+){{{words - 1}}}[^{BLANKS}]") if words > 1 else line.rlike(f"[^{BLANKS}]")


def line_table(docs: DataFrame, words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, hash, site, at, x, m) for every line of ``words`` words or more of ``docs`` (doc_id, text, source).

    ``hash`` names the text, ``site`` the source (null is one more), ``at`` the place
    among the lines, ``x`` and ``m`` the line without the blanks around it.
    """
    site = F.xxhash64(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    lines = docs.select("doc_id", F.xxhash64("text").alias("hash"), site.alias("site"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    bare = lines.where(_long_enough(F.col("line"), words)).withColumn("line", F.regexp_replace("line", _TRIM, ""))
    return bare.select("doc_id", "hash", "site", "at", F.xxhash64("line").alias("x"), F.hash("line").alias("m"))


def _meet(rows: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose (x, m) is among the distinct ``keys``; beyond a broadcast each key's rows are dealt out by their ``by``."""
    if keys.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(keys), ["x", "m"], "left_semi")
    salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.hash(*by), F.lit(SALTS))).join(salted, ["x", "m", "salt"], "left_semi").drop("salt")


def spread_of(lines: DataFrame, sites: int = SITES, texts: int = MIN_TEXTS) -> DataFrame:
    """(x, m, rows, estimate, sites, boilerplate) for every key of a ``line_table``.

    ``sites`` is the exact spread where the estimate is near the threshold, else the
    estimate; ``boilerplate`` says whether it reaches ``sites``.  ``texts`` of 2 makes
    lines that only one text has no boilerplate, however often that text was copied.
    """
    if texts not in (1, 2):
        raise ValueError("texts is 1 or 2")
    several = F.lit(True) if texts == 1 else F.min("hash") != F.max("hash")
    keyed = lines.groupBy("x", "m").agg(F.count("*").alias("rows"), F.hll_sketch_agg("site", LG_K).alias("sketch"), several.alias("several"))
    keyed = keyed.select("x", "m", "rows", "several", F.hll_sketch_estimate("sketch").alias("estimate"))
    off = F.abs(F.col("estimate") - sites)
    keyed = cut(keyed.withColumn("near", off <= F.greatest(F.lit(1.0), F.col("estimate") * MARGIN)))
    pairs = lines.select("x", "m", "site").distinct()
    exact = _meet(pairs, cut(keyed.where("near and several").select("x", "m")), ["site"]).groupBy("x", "m").agg(F.count("*").alias("exact"))
    found = keyed.join(exact, ["x", "m"], "left").withColumn("sites", F.coalesce("exact", "estimate"))
    return found.select("x", "m", "rows", "estimate", "sites", (F.col("several") & (F.col("sites") >= sites)).alias("boilerplate"))


def spread(docs: DataFrame, sites: int = SITES, words: int = MIN_WORDS, texts: int = MIN_TEXTS) -> DataFrame:
    """``spread_of`` the lines of ``docs``."""
    return spread_of(cut(line_table(docs, words)), sites, texts)


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines at the sorted places ``gone``: what stands between them is joined again."""
    whole = F.struct(F.split(text, "\n").alias("lines"), gone.alias("gone"))

    def joined(s: Column) -> Column:
        start = F.concat(F.array(F.lit(0)), F.transform(s["gone"], lambda p: p + 1))
        end = F.concat(s["gone"], F.array(F.size(s["lines"])))
        runs = F.filter(F.zip_with(start, end, lambda a, b: F.struct(a.alias("a"), (b - a).alias("n"))), lambda r: r["n"] > 0)
        return F.array_join(F.transform(runs, lambda r: F.array_join(F.slice(s["lines"], r["a"] + 1, r["n"]), "\n")), "\n")

    # Bound as a lambda's variable, so that the text is split once.
    return F.get(F.transform(F.array(whole), joined), 0)


def cleaned(docs: DataFrame, sites: int = SITES, words: int = MIN_WORDS, texts: int = MIN_TEXTS) -> DataFrame:
    """(row, new_text, removed): every row of ``docs`` as a struct, its text without boilerplate lines, their number.

    Lines are what stands between line feeds; other lines keep their place and bytes,
    lines of blanks alone are never boilerplate.  A null text stays null, a null source
    counts as one more site.  Repeated rows are cleaned each.  Columns of any name may
    stand beside doc_id, text and source.
    """
    lines = cut(line_table(docs, words))
    bad = cut(spread_of(lines, sites, texts).where("boilerplate").select("x", "m"))
    hits = _meet(lines, bad, ["doc_id", "hash"])
    hits = hits.groupBy(F.col("doc_id").alias("d"), F.col("hash").alias("h")).agg(F.sort_array(F.collect_set("at")).alias("gone"))
    rows = docs.select(packed(docs).alias("row"), "doc_id", F.xxhash64("text").alias("hash"))
    rows = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")), "left")
    text = F.col("row.text")
    new = F.when(F.col("gone").isNull(), text).otherwise(_without(text, F.col("gone")))
    return rows.select("row", new.alias("new_text"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("removed"))


def dedup(docs: DataFrame, sites: int = SITES, words: int = MIN_WORDS, texts: int = MIN_TEXTS) -> DataFrame:
    """``docs`` with the cleaned text in place of the text, ``n_chars`` brought up to date if it is there."""
    done = cleaned(docs, sites, words, texts)
    return done.select(*unpacked(docs, text=F.col("new_text"), n_chars=F.coalesce(F.length("new_text"), F.lit(0))))


def report(docs: DataFrame) -> DataFrame:
    """The op7 report: lines removed from every document and a digest of what stays."""
    new = F.coalesce("new_text", F.lit(""))
    return cleaned(docs).select(
        F.col("row.doc_id").alias("doc_id"),
        F.size(F.split(F.coalesce("row.text", F.lit("")), "\n")).cast("long").alias("n_lines"),
        F.col("removed").alias("n_removed"),
        F.length(new).cast("long").alias("n_chars"),
        F.md5(new).alias("text_md5"),
    )


#: The same in DuckDB: exact spreads, lines keyed by their bare text.
ORACLE = f"""
with docs as (
  select row_number() over () as r, doc_id, source, text from documents
), lines as (
  select r, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) as i
  from docs where text is not null
), bare as (
  select *, regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') as b,
         regexp_matches(line, '[^\\x20\\x09-\\x0D]') as ok
  from lines
), bad as (
  select b from bare join docs using (r) where ok group by b having count(distinct coalesce('s' || docs.source, '')) >= {SITES}
), kept as (
  select r, count(*) as n, count(*) filter (ok and b in (select b from bad)) as removed,
         string_agg(line, chr(10) order by i) filter (not (ok and b in (select b from bad))) as short
  from bare group by r
)
select d.doc_id, cast(coalesce(k.n, 1) as bigint) as n_lines, cast(coalesce(k.removed, 0) as bigint) as n_removed,
       cast(length(coalesce(k.short, '')) as bigint) as n_chars, md5(coalesce(k.short, '')) as text_md5
from docs d left join kept k on d.r = k.r
"""
