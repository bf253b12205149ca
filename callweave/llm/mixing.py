"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is due the same number of copies, target / size of the
source, which is rarely whole.  The fractions are rounded in pairs: of two
documents with fractions a and b, one randomly takes mass from the other until one
of the two is whole, with probabilities that keep each expectation.  What stays
fractional goes on to the next pair.  Pairs are neighbours by size, so that mass
moves between documents of similar size, and the largest come first, so that what is
left at the end is small: the words taken stay near the target.

Rounding runs as a reduction tree: groups of about ``GROUP`` documents of one
source and size class are rounded side by side and leave one fractional document
each; these residuals are grouped again, until a source has one, which is drawn by
its own probability.  No group is larger than about ``GROUP``, however many rows
one source has, and texts take no part: only (doc_id, source, size) travel.

DataFrame expressions only.  Random numbers are hashes of the documents, so a
rerun gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.common import BLANKS, cut, packed, unpacked

#: Documents rounded one after the other in one group, on average.
GROUP = 96
#: Size classes for each doubling of the size.
CLASSES = 3
#: Fractions so near 0 or 1 count as whole.
EPSILON = 1e-9
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2


def words(text: str = "text") -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANKS}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Targets of the sources from (source, source_size): ``target`` in words.

    Sources in order of code point, null last, take ``weights`` in turn and share
    ``share`` times all words by weight.  No target is above ``most`` times its
    source; what is over goes to the others by weight, until none is above.  In
    order of size / weight the sources that reach their limit come first, so
    running sums give the level at once.  ``share`` must not be above ``most``.
    """
    everything, by_name = Window.partitionBy(), Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("long"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "_all": F.sum("source_size").over(everything),
            "_size": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    level = (share * F.col("_all") - most * F.col("_size")) / F.col("_weight")
    rows = rows.withColumn("_level", level).withColumn("_free", F.col("_level") * F.col("weight") <= most * F.col("source_size"))
    level = F.min(F.when(F.col("_free"), F.struct("_size", "_level"))).over(everything)["_level"]
    limit = (most * F.col("source_size")).cast("double")
    target = F.when(level.isNull(), limit).otherwise(F.least(limit, level * F.col("weight")))
    return rows.select("source", "source_size", target.alias("target"))


def _uniform(*parts) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def _round(items: Column) -> Column:
    """Sequential pivotal rounding of an ordered array of items with ``p`` and ``u``.

    Gives a struct: ``done``, the items with their ``take``, and ``rest``, the item
    that is still fractional, or null.
    """
    put = lambda x, **new: x.withField("p", new["p"]) if "p" in new else x.withField("take", new["take"])

    def step(acc: Column, b: Column) -> Column:
        a, pa, pb = acc["rest"], acc["rest"]["p"], b["p"]
        total = pa + pb
        low = total < 1
        # Below 1 in sum one item is emptied, else one is filled; the other keeps what is left.
        keep_a = F.when(low, b["u"] * total < pa).otherwise(b["u"] * (2 - total) < 1 - pa)
        left = F.when(low, total).otherwise(total - 1)
        kept, out = F.when(keep_a, a).otherwise(b), F.when(keep_a, b).otherwise(a)
        out = put(out, take=F.when(low, 0).otherwise(1))
        none = F.lit(None).cast(_ITEM)
        whole = F.when(left < EPSILON, 0).when(left > 1 - EPSILON, 1)
        first = F.struct(acc["done"].alias("done"), b.alias("rest"))
        done = F.struct(F.concat(acc["done"], F.array(out, put(kept, take=whole))).alias("done"), none.alias("rest"))
        on = F.struct(F.concat(acc["done"], F.array(out)).alias("done"), put(kept, p=left).alias("rest"))
        return F.when(a.isNull(), first).when(whole.isNotNull(), done).otherwise(on)

    start = F.struct(F.array().cast(f"array<{_ITEM}>").alias("done"), F.lit(None).cast(_ITEM).alias("rest"))
    return F.aggregate(items, start, step)


_ITEM = "struct<size:bigint,u:double,doc_id:bigint,rows:bigint,source_size:bigint,target:double,p:double,take:int>"
_NAMES = ["size", "u", "doc_id", "rows", "source_size", "target", "p", "take"]


def _level(rows: DataFrame, n: int, classes: bool) -> DataFrame:
    """One level of the tree: (source, done, rest) for each group of its rows."""
    kind = F.floor(F.log2(F.col("size") + 1) * CLASSES) if classes else F.lit(0)
    rows = rows.withColumn("_class", kind.cast("int"))
    counts = rows.groupBy("source", "_class").agg(F.count("*").alias("_n"))
    in_source = Window.partitionBy("source")
    counts = counts.withColumn("_small", F.sum("_n").over(in_source) <= GROUP)
    counts = counts.select(F.col("source").alias("_s"), F.col("_class").alias("_c"), "_n", "_small")
    # A few dozen rows a source; Spark broadcasts them only below its size threshold, or else splits skewed joins.
    rows = rows.join(counts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")))
    parts = F.ceil(F.col("_n") / GROUP)
    rows = rows.select(
        "source",
        F.when(F.col("_small"), -1).otherwise(F.col("_class")).alias("_class"),
        F.when(F.col("_small"), 0).otherwise(F.pmod(F.xxhash64("doc_id", "size", F.lit(-1 - n)), parts)).alias("_part"),
        F.struct(F.col("size"), _uniform("source", "doc_id", "size", F.lit(n)).alias("u"), *[F.col(c) for c in _NAMES[2:]]).cast(_ITEM).alias("item"),
    )
    groups = rows.groupBy("source", "_class", "_part").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
    return groups.select("source", _round(F.col("items")).alias("r")).select("source", "r.done", "r.rest")


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Copies of every row of ``docs`` (doc_id, source, size): adds source_size, target and copies.

    Null sources are one source, the last.  Rows with equal doc_id, source and size
    are rounded together and differ by one copy at most.  Sources without words
    get the target 0 and no copies; an empty table gives an empty result.
    """
    docs = cut(docs.select("doc_id", "source", "size"))  # words are counted once
    units = docs.groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows"))
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sizes, weights, share, most).withColumnRenamed("source", "_s")
    rows = units.join(goals, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    due = F.least(F.lit(float(most)), F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))
    rows = rows.withColumn("p", F.coalesce(F.col("rows") * (due - F.floor(due)), F.lit(0.0)))
    rows = rows.withColumn("p", F.col("p") - F.floor(F.col("p"))).withColumn("take", F.lit(0))
    fractional = (F.col("p") > EPSILON) & (F.col("p") < 1 - EPSILON)
    rows = cut(rows)
    whole = rows.where(~fractional).withColumn("take", F.when(F.col("p") >= 0.5, 1).otherwise(0))
    done = [whole.select("source", *_NAMES_OUT)]
    rest, n, classes = rows.where(fractional), 0, True
    while True:
        level = cut(_level(rest, n, classes))
        done.append(level.select("source", F.explode("done").alias("x")).select("source", *[f"x.{c}" for c in _NAMES_OUT]))
        rest = level.where(F.col("rest").isNotNull()).select("source", "rest.*")
        most_left = rest.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if most_left <= 1:
            break
        n, classes = n + 1, False
    last = rest.withColumn("take", (_uniform("source", "doc_id", "size", F.lit(-1)) < F.col("p")).cast("int"))
    done.append(last.select("source", *_NAMES_OUT))
    both = done[0]
    for x in done[1:]:
        both = both.unionByName(x)
    due = F.coalesce(due, F.lit(0.0))
    extra = F.floor(F.col("rows") * (due - F.floor(due)) + EPSILON) + F.col("take")
    both = both.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    more = F.when(F.col("_i") <= extra, 1).otherwise(0)
    return both.select("doc_id", "source", "size", "source_size", "target", (F.floor(due) + more).cast("long").alias("copies"), "_i")


_NAMES_OUT = ["doc_id", "size", "rows", "source_size", "target", "take"]


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", words().alias("size"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it, in the columns of ``docs``.

    A row that is taken twice is there twice.  The texts are shuffled once, to meet
    their copies; rows with equal doc_id, source and size are numbered in order of
    their text's hash.  Columns of any name may stand beside doc_id, text and source.
    """
    found = copies(sized(docs), weights, share, most).where("copies > 0")
    found = found.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_n"), F.col("_i").alias("_j"), "copies")
    rows = docs.select(packed(docs).alias("row"), "doc_id", "source", words().alias("size"), F.xxhash64("text").alias("hash"))
    number = Window.partitionBy("doc_id", "source", "size").orderBy("hash")
    rows = rows.withColumn("at", F.row_number().over(number))
    same = (
        F.col("doc_id").eqNullSafe(F.col("_d"))
        & F.col("source").eqNullSafe(F.col("_s"))
        & (F.col("size") == F.col("_n"))
        & (F.col("at") == F.col("_j"))
    )
    taken = rows.join(found, same).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select(*unpacked(docs))


def report(docs: DataFrame) -> DataFrame:
    """The op2 report: what the mix takes of every row."""
    return copies(sized(docs)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies"
    )

