"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A text is cut at line breaks and at ends of sentences and clauses; every piece is
hashed to ``LANES`` entries of 16 bits, centred on zero, and the entries of all
pieces are summed lane by lane modulo 2**32.  The sum

* does not depend on the order of the pieces,
* is updated by adding (inserting) or subtracting (deleting) a piece's vector,
* estimates how alike two texts are: the squared length of the difference of two
  sums estimates the number of pieces by which the multisets differ.

Everything is DataFrame expressions.  Pieces are exploded and summed back per row
in one hash aggregate, which keeps one entry a row before the shuffle, so only the
lane sums travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.common import text_of

#: Lanes of a fingerprint; four come from each 64-bit hash.
LANES = 32
MODULUS = 1 << 32
#: Cuts a text: line breaks, and blanks after these marks.
CUT = r"[\n\r]+|(?<=[.!?,;:|]) +"
#: A bucket of the order of documents holds about so many rows; there are so many buckets at most.
BUCKET_ROWS, MOST_BUCKETS, QUANTILES = 500, 1 << 20, 64
#: Buckets that one task reads, on average.
TASK_BUCKETS = 8


def pieces(text: Column) -> Column:
    """The multiset of non-empty pieces of a text."""
    return F.filter(F.split(text, CUT), lambda x: x != "")


def lane_sums(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """One row for each key with ``lanes``, its sums modulo 2**32; a text without pieces has zeros."""
    units = df.select(*keys, F.explode_outer(pieces(text)).alias("_piece"))
    hashed = [F.when(F.col("_piece").isNotNull(), F.xxhash64("_piece", F.lit(i))).alias(f"_h{i}") for i in range(LANES // 4)]
    entry = lambda i: F.shiftrightunsigned(f"_h{i // 4}", 16 * (i % 4)).bitwiseAND(65535) - 32768
    sums = units.select(*keys, *hashed).groupBy(*keys).agg(*[F.sum(entry(i)).alias(f"_s{i}") for i in range(LANES)])
    lanes = F.array(*[F.coalesce(F.col(f"_s{i}"), F.lit(0)) for i in range(LANES)])
    return sums.select(*keys, F.transform(lanes, lambda x: x.bitwiseAND(MODULUS - 1)).alias("lanes"))


def as_text(lanes: Column) -> Column:
    """Lanes as lowercase hex, eight digits each."""
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def _square(lanes: Column) -> Column:
    signed = lambda x: F.when(x >= MODULUS // 2, x - MODULUS).otherwise(x).cast("double")
    return F.aggregate(F.transform(lanes, signed), F.lit(0.0), lambda total, x: total + x * x)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of pieces in common (0 to 1): 1 - |a-b|^2 / (|a|^2 + |b|^2), 1 for two empty texts."""
    both = _square(a) + _square(b)
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - _square(delete(a, b)) / both))


def insert(a: Column, b: Column) -> Column:
    """Lanes of the multiset sum: the fingerprint after inserting what ``b`` stands for."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, F.lit(MODULUS)))


def delete(a: Column, b: Column) -> Column:
    """Lanes of the multiset difference: the fingerprint after deleting what ``b`` stands for."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(MODULUS)))


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fingerprint`` for every distinct (key, text) row; null texts count as empty.

    Keys should be unique; rows that share a key are taken as parts of one
    document, whose pieces are summed.
    """
    return lane_sums(docs, [key], text_of(text)).select(key, as_text(F.col("lanes")).alias("fingerprint"))


def _ordered(docs: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Adds ``_bucket``: contiguous ranges of ``key`` with similar numbers of rows, in order of the key; and their number."""
    marks = [i / QUANTILES for i in range(QUANTILES + 1)]
    row = docs.agg(F.count("*").alias("n"), F.percentile_approx(key, F.array(*map(F.lit, marks)), 10_000).alias("q")).first()
    cuts = [int(x) for x in row.q or [0] * (QUANTILES + 1)]  # no key at all
    inner = max(1, min(MOST_BUCKETS // QUANTILES, -(-row.n // (BUCKET_ROWS * QUANTILES))))
    array = F.expr(f"array({', '.join(f'{x}L' for x in cuts)})")
    docs = docs.withColumn("_id", F.coalesce(F.col(key), F.lit(cuts[0] - 1)))
    docs = docs.withColumn("_q", F.size(F.filter(array, lambda x: x <= F.col("_id"))))
    docs = docs.withColumn("_q", F.least(F.greatest("_q", F.lit(1)), F.lit(QUANTILES)))
    docs = docs.withColumns({"_low": F.element_at(array, F.col("_q")), "_high": F.element_at(array, F.col("_q") + 1)})
    part = (F.col("_id") - F.col("_low")).cast("double") / (F.col("_high") - F.col("_low") + 1).cast("double")
    sub = F.least(F.greatest(F.floor(part * inner), F.lit(0)), F.lit(inner - 1))
    return docs.withColumn("_bucket", (F.col("_q") - 1) * inner + sub).drop("_q", "_low", "_high"), inner * QUANTILES


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with ``next_text``: the text of the row after it by descending key, the first after the last.

    Rows are ranged into buckets of the key.  The first row of each bucket is also
    sent to the end of the bucket before it in that order, as a ghost, so one shuffle
    and a window in each bucket are enough; no task sees all rows.  Null keys come
    last, equal keys are in order of their text.  Adds ``_bucket`` and ``_at``, which
    together name a row and follow the order within a bucket, and ``_ghost``.
    """
    rows, buckets = _ordered(docs.select(F.col(key).alias("key"), text_of(text).alias("text")), "key")
    firsts = rows.groupBy("_bucket").agg(F.max("_id").alias("_first"))
    # At most MOST_BUCKETS rows of two longs.
    before = F.lead("_bucket").over(Window.orderBy("_bucket"))
    firsts = firsts.select("_bucket", "_first", F.coalesce(before, F.min("_bucket").over(Window.partitionBy())).alias("_before"))
    rows = rows.join(F.broadcast(firsts), "_bucket")
    real = F.struct(F.col("_bucket").alias("to"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.col("_before").alias("to"), F.lit(True).alias("ghost"))
    rows = rows.select(
        "key", "text", "_id", F.explode(F.when(F.col("_id") == F.col("_first"), F.array(real, ghost)).otherwise(F.array(real))).alias("_x")
    ).select("key", "text", "_id", F.col("_x.to").alias("_bucket"), F.col("_x.ghost").alias("_ghost"))
    # Tasks grow in number, not in size.
    rows = rows.repartition(max(1, buckets // TASK_BUCKETS), "_bucket")
    order = Window.partitionBy("_bucket").orderBy("_ghost", F.desc("_id"), "text")
    return rows.withColumns({"next_text": F.lead("text").over(order), "_at": F.row_number().over(order)}).drop("_id")


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``with_next`` plus ``n_chars`` and ``edited``: the last third replaced by the start of the next text."""
    rows = with_next(docs, key, text)
    third = F.floor(F.length("text") / 3).cast("int")
    return rows.withColumns(
        {
            "n_chars": F.length("text").cast("long"),
            "edited": F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third)),
        }
    )


def compare_edited(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The op4 report: fingerprints of each text and of its edited text, and their likeness.

    Each text is hashed once; the next document's lanes come from the row after it.
    Equal keys are told apart by their place in the order, so repeated rows give
    repeated results; a null text counts as empty, and the only document of a table is
    its own next.  An empty table gives an empty result.
    """
    rows = edited(docs, key)
    names = ["_bucket", "_at", "_ghost", "key", "n_chars", "edited_sha256"]
    bodies = [F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("body"))]
    # Of a ghost only its own text counts.
    bodies = F.when(F.col("_ghost"), F.array(bodies[0])).otherwise(F.array(*bodies))
    flat = rows.withColumn("edited_sha256", F.sha2("edited", 256)).select(*names, F.explode(bodies).alias("_x"))
    sums = lane_sums(flat.select(*names, F.col("_x.which").alias("_which"), F.col("_x.body").alias("_body")), [*names, "_which"], F.col("_body"))
    pick = [F.max(F.when(F.col("_which") == i, F.col("lanes"))).alias(f"_v{i}") for i in range(2)]
    wide = sums.groupBy(*names).agg(*pick)
    wide = wide.withColumn("_v2", F.lead("_v0").over(Window.partitionBy("_bucket").orderBy("_at"))).where(~F.col("_ghost"))
    return wide.select(
        F.col("key").alias(key),
        "n_chars",
        "edited_sha256",
        as_text(F.col("_v0")).alias("fingerprint"),
        as_text(F.col("_v1")).alias("edited_fingerprint"),
        likeness(F.col("_v0"), F.col("_v1")).alias("near_edited"),
        likeness(F.col("_v0"), F.col("_v2")).alias("near_next"),
    )
