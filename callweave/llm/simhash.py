"""SimHash near-duplicates with pigeonring filtering.

A fingerprint bit is set where more than half of a document's shingle hashes have
it set.  Of two fingerprints with at most t differing bits, cut into m segments on a
ring, some segment starts a chain whose first l segments differ in at most l*t/m
bits, for every l (the pigeonring principle).  Candidates come from equality joins
on what a chain's first segments must share; a candidate must then keep within the
budget of every chain length before all bits are compared.

Equal fingerprints are one class from the start, so copies never meet each other.
Only classes are joined.  Within a group that shares a key links travel as a spanning
forest, never as all pairs; a group over ``GROUP`` rows is dealt into pairs of blocks.
Components of the forests are found by :mod:`callweave.llm.components`.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import BLANKS, arrow_map, cut, packed, unpacked
from callweave.llm.components import components

#: Segments of a 64-bit fingerprint on its ring.
SEGMENTS, BITS = 8, 64
#: Rows of a group that shares a key which one task compares, and keys over that which are broadcast at most.
GROUP, MOST_BROADCAST = 4096, 250_000
#: Shingles hashed at once, so that a very long text takes little memory.
SLICE = 1 << 16


def _hashes(words: list[str], n: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of ``n`` words, repeats included; fewer words make one shingle."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= n:
        shingles = [" ".join(words)]
    else:
        shingles = map(" ".join, zip(*[words[i:] for i in range(n)], strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)


def _mixed(h: np.ndarray, i: int) -> np.ndarray:
    """The hashes again for the ``i``-th 64 bits of a wider fingerprint; the first are the hashes themselves."""
    if i:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def majority(h: np.ndarray, longs: int = 1) -> list[int]:
    """The fingerprint of shingle hashes as signed 64-bit numbers: bits set in over half of them."""
    out = []
    for i in range(longs):
        count = np.zeros(64, np.int64)
        for at in range(0, len(h), SLICE):
            part = _mixed(h[at : at + SLICE], i).astype(">u8").view(np.uint8).reshape(-1, 8)
            count += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
        out.append(int(np.packbits(count * 2 > len(h)).view(">i8")[0]))
    return out


def _words():
    import re

    blank = re.compile(f"[{BLANKS}]+")
    lower = {i: i + 32 for i in range(65, 91)}

    def cut(text: str | None) -> list[str]:
        text = text or ""
        return [w for w in blank.split(text.lower() if text.isascii() else text.translate(lower)) if w]

    return cut


def fingerprints(docs: DataFrame, words: int = 3, longs: int = 1) -> DataFrame:
    """(doc_id, fps: array of ``longs`` 64-bit numbers) for every row of ``docs`` (doc_id, text).

    Words are runs of other characters than blanks, A-Z lower-cased.  A text without
    words, or a null one, has the fingerprint zero.
    """

    def make():
        cut = _words()
        return lambda rows: {"doc_id": rows["doc_id"], "fps": [majority(_hashes(cut(t), words), longs) for t in rows["text"]]}

    return arrow_map(docs.select("doc_id", "text"), None, "doc_id long, fps array<long>", make)


def _bits(x: Column, low: int, n: int) -> Column:
    return F.shiftrightunsigned(x, low).bitwiseAND((1 << n) - 1)


def _rotated(fp: Column, start: int) -> Column:
    """The fingerprint with segment ``start`` lowest."""
    by = start * BITS // SEGMENTS
    return fp if not by else F.shiftrightunsigned(fp, by).bitwiseOR(F.shiftleft(fp, BITS - by))


def _keys() -> Column:
    """Join keys of a fingerprint for up to 3 differing bits in 8 segments: 24 of 32 bits each.

    The budgets of chains of 1 to 5 segments are 0, 0, 1, 1 and 1 bits: the first two
    segments are equal, and of the next three at least two are.  One key for each start
    and each of the three that may differ.
    """
    keys = []
    for start in range(SEGMENTS):
        r = _rotated(F.col("fp"), start)
        first = _bits(r, 0, 16)
        for out in range(3):
            kept = [s for s in (2, 3, 4) if s != 2 + out]
            key = first.bitwiseOR(F.shiftleft(_bits(r, 8 * kept[0], 8), 16)).bitwiseOR(F.shiftleft(_bits(r, 8 * kept[1], 8), 24))
            keys.append(F.struct(F.lit(start).alias("start"), key.bitwiseOR(F.lit((start * 3 + out) << 32)).alias("key")))
    return F.array(*keys)


class Forest:
    """Union-find over ids; ``join`` says whether two were apart."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def top(self, x: int) -> int:
        above, at = self.above, x
        while (up := above.get(at, at)) != at:
            at = up
        while (up := above.get(x, x)) != at:
            above[x] = at
            x = up
        return at

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.above[max(a, b)] = min(a, b)
        return a != b


Close = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray]


def _near_in_groups(columns: dict[str, np.ndarray], close: Close, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the close pairs with equal ``key``; rows are in order of ``key``, then ``n``.

    Sizes ``n`` of a pair may differ by the factor ``similarity`` at most.
    """
    key, ids, n, side = (columns[c] for c in ("key", "id", "n", "side"))
    forest, out = Forest(), []
    at, lag = np.arange(len(key)), 0
    while True:
        # Who has no partner at one distance has none further off.
        lag += 1
        at = at[at + lag < len(key)]
        at = at[(key[at] == key[at + lag]) & (n[at] >= similarity * n[at + lag])]
        if not len(at):
            return out
        a = at[(side[at] == WHOLE) | (side[at] != side[at + lag])]
        a = a[close(columns, a, a + lag)]
        out += [(x, y) for x, y in zip(ids[a].tolist(), ids[a + lag].tolist(), strict=True) if x != y and forest.join(x, y)]


#: Side of a row in a group that is compared whole; 0 and 1 are compared with each other.
WHOLE = 2


def _dealt(rows: DataFrame, counted: DataFrame, others: int = 0) -> DataFrame:
    """``rows`` (key, id, ...) with ``side``; keys with over ``GROUP`` rows are dealt into pairs of blocks with keys of their own.

    ``counted`` has the keys to count; of rows beyond it no key has over ``others``.
    """
    n = F.count("*") + others
    large = cut(counted.groupBy("key").agg(n.alias("_n")).where(F.col("_n") > GROUP).select("key", F.ceil(F.col("_n") / GROUP).alias("_blocks")))
    number = large.count()
    if not number:
        return rows.withColumn("side", F.lit(WHOLE))
    # At most the rows over GROUP; beyond the bound a plain join.
    rows = rows.join(F.broadcast(large) if number <= MOST_BROADCAST else large, "key", "left")
    block = F.coalesce(F.pmod(F.xxhash64("id"), F.col("_blocks")), F.lit(0))
    rows = rows.withColumn("_block", block).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_blocks") - 1, F.lit(0)))))
    pair = F.xxhash64("key", F.least("_block", "_other"), F.greatest("_block", "_other"))
    side = F.when(F.col("_block") == F.col("_other"), WHOLE).when(F.col("_block") < F.col("_other"), 0).otherwise(1)
    rows = rows.withColumn("side", side).withColumn("key", F.when(F.col("_blocks").isNull(), F.col("key")).otherwise(pair))
    return rows.drop("_n", "_blocks", "_block", "_other")


def grouped_forests(rows: DataFrame, close: Close, similarity: float = 0.0, counted: DataFrame | None = None, others: int = 0) -> DataFrame:
    """(a, b): for every ``key`` of ``rows`` (key, id, n, more numbers) a spanning forest of the pairs that are ``close``.

    Rows are dealt out by their key and read in order; a task holds one group, of
    ``GROUP`` rows or some more, at a time.  ``counted`` and ``others`` as in ``_dealt``.
    """
    import pyarrow as pa

    rows = _dealt(rows, rows if counted is None else counted, others).repartition("key").sortWithinPartitions("key", "n")
    names = rows.columns

    def run(batches):
        rest: dict[str, np.ndarray] | None = None

        def found(columns):
            pairs = _near_in_groups(columns, close, similarity)
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            columns = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(names)}
            if rest is not None:
                columns = {n: np.concatenate((rest[n], columns[n])) for n in names}
            whole = int(np.searchsorted(columns["key"], columns["key"][-1])) if len(columns["key"]) else 0
            if whole > 1:
                yield found({n: c[:whole] for n, c in columns.items()})
            rest = {n: c[whole:] for n, c in columns.items()}
        if rest is not None and len(rest["key"]) > 1:
            yield found(rest)

    return rows.mapInArrow(run, "a long, b long").distinct()


def _in_chain(columns: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The pigeonring check of pairs that share a key: every chain from the key's start within its budget, then all bits."""
    fp = columns["id"].view(np.uint64)
    apart = fp[a] ^ fp[b]
    width = np.uint64(BITS // SEGMENTS)
    by = columns["n"][a].astype(np.uint64) * width
    ring = (apart >> by) | np.where(by == 0, np.uint64(0), apart << ((np.uint64(BITS) - by) % np.uint64(BITS)))
    good = np.ones(len(a), bool)
    for n in range(2, SEGMENTS):
        good &= np.bitwise_count(ring & np.uint64((1 << n * BITS // SEGMENTS) - 1)) <= n * most // SEGMENTS
    return good & (np.bitwise_count(apart) <= most)


def links(classes: DataFrame, most: int = 3) -> DataFrame:
    """Pairs (a, b) that connect the distinct fingerprints ``fp`` of ``classes`` as those with at most ``most`` (up to 3) differing bits do.

    Complete: no connection is lost, whatever the sizes of the groups that share a key.
    Each pair is a link; of a group's links a spanning forest is given.
    """
    if not 0 <= most <= 3:
        raise ValueError("the keys hold for up to 3 differing bits")
    rows = classes.select("fp", F.explode(_keys()).alias("k")).select("k.key", F.col("fp").alias("id"), F.col("k.start").alias("n"))
    return grouped_forests(rows, lambda columns, a, b: _in_chain(columns, a, b, most))


def near_duplicates(docs: DataFrame, words: int = 3, most: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    ``component_id`` is the least doc_id that is reachable over links, the row's own
    included.  Null doc_ids count only where a component has no other.
    """
    fps = cut(fingerprints(docs, words).select("doc_id", F.col("fps")[0].alias("fp")))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(links(classes, most)).select(F.col("node").alias("fp"), "component")
    # Of each class the component (its own fingerprint if it has no links), then the least document of each component.
    named = cut(classes.join(groups, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = named.join(least, "component").select(F.col("fp").alias("_fp"), "component_id")
    found = fps.join(labels, F.col("fp") == F.col("_fp"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near-duplicates by Jaccard similarity of shingle sets.
#
# A similarity of 0.8 is some 15% of differing bits of a fingerprint, for which no equal
# segments are selective, and only by chance a bound.  So the ring is made of the sets
# themselves: sets of a and b shingles at a similarity of s differ in at most
# t = (a + b) * (1 - s) / (1 + s) shingles.  The shingles are dealt by hash to m > t
# segments on a ring, m by t alone, so some segment starts a chain whose first l segments
# differ in at most l * t / m shingles, for every l; the start itself is equal.  Segments
# that both sets have empty, or equal and held by over ``HOT`` sets, differ in nothing and
# are left out of the pair's ring; so they start no chain unless a set has no more than t
# others.  Sets join on equal starts; the next ``CHAIN`` segments of a start travel with it
# as a byte each, and an unequal one counts as one shingle.  What keeps the budgets is joined
# to loose groups by spanning forests.  Each set is then sent to its loose group once for
# each block of it, a wide Hamming check prunes pairs, and the sets decide.
#
#: Segments of the smallest ring, each next one has twice as many; a ring of m is for up to (m - SPARE) / SLACK differing shingles.
RING, SPARE, SLACK = 5, 3, 1.25
#: Bytes of a segment's number, and segments after a start that are checked with it.
SEGMENT_BYTES, CHAIN = 4, 6
#: Of WIDE_LONGS * 64 bits so many may differ in a pair whose sets are compared: some 6 standard deviations over what 0.8
#: makes.  Pairs with a set of SMALL or fewer shingles go by their sets alone.
WIDE_LONGS, WIDE_BITS, SMALL = 16, 224, 48
#: A segment of more sets is hot; the number rises until there are at most MOST_BROADCAST such.  Which are hot decides
#: the work, not the result, so they are counted in one of SAMPLED sets.
HOT, SAMPLED = 1000, 8
#: Members and shingles of a block of a loose group, on average.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20


def _apart(similarity: float, both: int | np.ndarray) -> int | np.ndarray:
    """The most shingles in which two similar sets differ that have ``both`` together."""
    return np.floor(both * ((1 - similarity) / (1 + similarity)) + 1e-6).astype(np.int64)


def _rings(similarity: float, n: int) -> list[tuple[int, int]]:
    """(segments, most differing shingles) of every ring on which a set of ``n`` shingles meets similar sets, equal ones apart."""
    low = max(1, int(_apart(similarity, n + math.ceil(similarity * n - 1e-6))))
    high = int(_apart(similarity, n + math.floor(n / similarity + 1e-6)))
    found, m = [], RING
    while low <= high:
        most = int((m - SPARE) / SLACK)
        if low <= most:
            found.append((m, min(high, most)))
            low = most + 1
        m *= 2
    return found


def _segments(shingles: np.ndarray, m: int) -> np.ndarray:
    """A number for each of ``m`` segments of a sorted set, 0 for an empty one; equal segments have equal numbers."""
    out = np.zeros(m, np.uint64)
    if len(shingles):
        place = (shingles >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        out[place[starts].astype(np.int64)] = _numbers(np.add.reduceat(_mixed(shingles, 1), starts))
    return out


def _numbers(h: np.ndarray) -> np.ndarray:
    return np.maximum(h >> np.uint64(64 - 8 * SEGMENT_BYTES), np.uint64(1))


def _profile(shingles: np.ndarray, similarity: float) -> dict:
    """Size and digest of a sorted set, and its rings; one with too few filled segments is followed by the shingles, each a segment."""
    import xxhash

    digest, rings = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64), []
    for m, most in _rings(similarity, len(shingles)):
        rings.append(_segments(shingles, m))
        if np.count_nonzero(rings[-1]) <= most:
            rings.append(_numbers(_mixed(shingles, 1)))
    numbers = np.concatenate(rings) if rings else np.zeros(0, np.uint64)
    packed_rings = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SEGMENT_BYTES].tobytes()
    return {"n": len(shingles), "d0": int(digest[0]), "d1": int(digest[1]), "rings": packed_rings}


def _chains(ring: np.ndarray) -> np.ndarray:
    """For every segment the last bytes of the next ``CHAIN`` ones, the nearest lowest."""
    m = len(ring)
    last = (ring & np.uint64(255)).astype(np.uint8)
    after = np.zeros((m, 8), np.uint8)
    after[:, :CHAIN] = np.lib.stride_tricks.sliding_window_view(np.resize(last, m + CHAIN), CHAIN)[1:]
    after[:, m - 1 :] = 0
    return after.view("<i8")[:, 0]


def _starts(n: int, rings: bytes, similarity: float, hot: np.ndarray, hot_only: bool = False) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(keys, chains, segments that are not hot) of the starts on each ring of a set of ``n`` shingles; ``hot`` holds sorted keys."""
    numbers = np.zeros((len(rings) // SEGMENT_BYTES, 8), np.uint8)
    numbers[:, :SEGMENT_BYTES] = np.frombuffer(rings, np.uint8).reshape(-1, SEGMENT_BYTES)
    numbers, out = numbers.view("<u8")[:, 0], []

    def add(ring: np.ndarray, keys: np.ndarray, chains: np.ndarray, most: int) -> None:
        filled = ring > 0
        warm = np.zeros(len(ring), bool)
        if len(hot):
            warm = hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys
        cold = filled & ~warm
        count = int(np.count_nonzero(cold))
        taken = cold if count > most else filled
        taken = taken & warm if hot_only else taken
        out.append((keys[taken], chains[taken], count))

    for m, most in _rings(similarity, n):
        ring, numbers = numbers[:m], numbers[m:]
        places = np.arange(m, dtype=np.uint64) << np.uint64(8 * SEGMENT_BYTES)
        add(ring, (_mixed(ring | places, 2) ^ np.uint64(m)).view(np.int64), _chains(ring), most)
        if np.count_nonzero(ring) <= most:
            ring, numbers = numbers[:n], numbers[n:]
            add(ring, (_mixed(ring, 3) ^ np.uint64(m)).view(np.int64), np.zeros(n, np.int64), most)
    return out


def _sets(docs: DataFrame, words: int, make: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """The other columns of ``docs`` (.., text), with what ``make`` gives for the sorted distinct shingle hashes of the text."""
    kept = [c for c in docs.columns if c != "text"]
    kinds = dict(docs.dtypes)

    def made():
        cut_words = _words()

        def work(rows: dict) -> dict:
            found = [make(np.unique(_hashes(cut_words(t), words))) for t in rows["text"]]
            return {c: rows[c] for c in kept} | {c: [f[c] for f in found] for c in (found[0] if found else {})}

        return work

    return arrow_map(docs, None, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", " + schema, made, step=128)


def chain_rows(classes: DataFrame, similarity: float, hot: np.ndarray, hot_only: bool = False) -> DataFrame:
    """(key, id, n, m, chain) for every start of ``classes`` (id, n, rings); with ``hot_only`` for those that are hot."""

    def work(rows: dict) -> dict:
        keys, ids, sizes, counts, chains = [], [], [], [], []
        for i, n, rings in zip(rows["id"], rows["n"], rows["rings"], strict=True):
            for key, chain, m in _starts(n, rings, similarity, hot, hot_only):
                keys.append(key)
                chains.append(chain)
                ids.append(np.full(len(key), i, np.int64))
                sizes.append(np.full(len(key), n, np.int32))
                counts.append(np.full(len(key), m, np.int32))
        joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return {"key": joined(keys, np.int64), "id": joined(ids, np.int64), "n": joined(sizes, np.int32), "m": joined(counts, np.int32), "chain": joined(chains, np.int64)}

    return arrow_map(classes.select("id", "n", "rings"), work, "key long, id long, n int, m int, chain long", step=32)


def _within_chains(columns: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """The pigeonring check of pairs with an equal start: its chains of up to ``CHAIN`` more segments, each within its budget."""
    n, m = columns["n"].astype(np.int64), columns["m"].astype(np.int64)
    most, ring = _apart(similarity, n[a] + n[b]), np.maximum(1, np.maximum(m[a], m[b]))
    apart, unequal, good = columns["chain"][a] ^ columns["chain"][b], np.zeros(len(a), np.int64), np.ones(len(a), bool)
    for i in range(CHAIN):
        unequal += (apart >> np.int64(8 * i)) & np.int64(255) != 0
        good &= unequal <= (i + 2) * most // ring
    return good


def _hot(classes: DataFrame, similarity: float) -> np.ndarray:
    """Keys that too many classes have, at most ``MOST_BROADCAST``, sorted."""
    some = classes.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0)
    counts = chain_rows(some, similarity, np.zeros(0, np.int64)).groupBy("key").agg((F.count("*") * SAMPLED).alias("n"))
    counts, least = cut(counts.where(F.col("n") > HOT)), HOT
    while (hot := counts.where(F.col("n") > least)).count() > MOST_BROADCAST:
        least *= 4
    return np.sort(np.array([r.key for r in hot.select("key").collect()], np.int64))


def loose_links(classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of ids of ``classes`` (id, n, rings): for every start of a chain a spanning forest of the classes that have it and keep its budgets.

    Complete: similar classes are connected.  Other keys than hot ones have some ``HOT``
    rows at most, so only hot ones are counted.
    """
    hot = _hot(classes, similarity)
    rows = chain_rows(classes, similarity, hot)
    counted = chain_rows(classes if len(hot) else classes.where("1 = 0"), similarity, hot, hot_only=True)
    return grouped_forests(rows, lambda columns, a, b: _within_chains(columns, a, b, similarity), similarity, counted.select("key"), HOT)


def _verified(members: list[dict], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of a block pair whose sets are similar: both blocks' members, or one block's own."""
    members = sorted(members, key=lambda m: len(m["shingles"]))
    ids = [m["id"] for m in members]
    sets = [np.frombuffer(m["shingles"], np.int64) for m in members]
    wide = np.stack([np.frombuffer(m["wide"], np.uint64) for m in members])
    size = np.array([len(s) for s in sets])
    first = np.array([m["first"] for m in members])
    mixed = first.any() and not first.all()
    forest, out = Forest(), []
    for i in range(len(ids)):
        rest = np.arange(i + 1, int(np.searchsorted(size, size[i] / similarity + 1e-6, "right")))
        rest = rest[first[rest] != first[i]] if mixed else rest
        if size[i] > SMALL:
            rest = rest[np.bitwise_count(wide[i] ^ wide[rest]).sum(1, dtype=np.int64) <= WIDE_BITS]
        for j in rest.tolist():
            if forest.top(ids[i]) != forest.top(ids[j]):
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common >= similarity * (size[i] + size[j] - common) - 1e-9:
                    forest.join(ids[i], ids[j])
                    out.append((ids[i], ids[j]))
    return out


def exact_links(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) from ``sets`` (component, id, shingles, wide; numbers as bytes): links that connect what similar pairs within a component connect.

    A component is dealt by hash into blocks of about ``BLOCK`` sets and
    ``BLOCK_SHINGLES`` shingles; each pair of blocks is one group, so no task holds
    more than two blocks.
    """
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("shingles") / 8) / BLOCK_SHINGLES))
    large = cut(sets.groupBy("component").agg(parts.alias("blocks")).where("blocks > 1"))
    # A component of several blocks has many sets; beyond the bound a plain join.
    rows = sets.join(F.broadcast(large) if large.count() <= MOST_BROADCAST else large, "component", "left")
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    group = [F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
    rows = rows.select("component", *group, "id", "shingles", "wide", (F.col("block") <= F.col("other")).alias("first"))
    lists = rows.groupBy("component", "i", "j").agg(F.collect_list(F.struct("id", "first", "shingles", "wide")).alias("members"))

    def work(columns: dict) -> dict:
        pairs = [p for members in columns["members"] for p in _verified(members, similarity)]
        return {"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}

    return arrow_map(lists.select("members"), work, "a long, b long", step=1)


def _row_key(doc_id: Column, text_hash: Column) -> list[Column]:
    """Columns d, z and h without nulls that tell (doc_id, text) apart, so that a join and a grouping by them share one shuffle."""
    return [F.coalesce(doc_id, F.lit(0)).alias("d"), doc_id.isNull().alias("z"), text_hash.alias("h")]


def near_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, hash, group_doc_id, group_hash) for every distinct (doc_id, text) of ``docs``.

    ``hash`` is the text's xxhash64.  Documents are in a group if a chain of pairs
    with a Jaccard similarity of ``similarity`` (0.8 or more) or more of their sets of
    ``words``-word shingles connects them; the group is named by its least (doc_id,
    hash).  Texts with equal sets are one class; texts without words form one class.
    """
    if similarity < 0.8:
        raise ValueError("the Hamming checks are made for a similarity of 0.8 or more")
    texts = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    keyed_texts = docs.select(*_row_key(F.col("doc_id"), F.xxhash64("text")), "text").dropDuplicates(["d", "z", "h"])
    found = cut(_sets(texts, words, lambda s: _profile(s, similarity), "n int, d0 long, d1 long, rings binary"))
    same = ["n", "d0", "d1"]
    classes = found.groupBy(*same).agg(F.min(F.struct("doc_id", "hash")).alias("first"), F.any_value("rings").alias("rings"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))

    def texts_of(wanted: DataFrame) -> DataFrame:
        """The text of each class of ``wanted`` (id), beside its id."""
        wanted = classes.join(wanted, "id", "left_semi").select("id", *_row_key(F.col("first.doc_id"), F.col("first.hash")))
        return keyed_texts.join(wanted, ["d", "z", "h"]).select("id", "text")

    loose = cut(components(loose_links(classes, similarity)).withColumnRenamed("node", "id"))
    whole = lambda s: {"shingles": s.tobytes(), "wide": np.array(majority(s, WIDE_LONGS), np.int64).tobytes()}
    sets = cut(_sets(texts_of(loose.select("id")), words, whole, "shingles binary, wide binary").join(loose, "id"))
    groups = components(exact_links(sets, similarity)).withColumnRenamed("node", "id")
    named = cut(classes.join(groups, "id", "left").select(*same, "first", F.coalesce("component", "id").alias("component")))
    best = named.groupBy("component").agg(F.min("first").alias("best"))
    labels = named.join(best, "component").select(*same, "best")
    return found.join(labels, same).select("doc_id", "hash", F.col("best.doc_id").alias("group_doc_id"), F.col("best.hash").alias("group_hash")).distinct()


def dedup(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of ``near_groups``, the one with the least doc_id.

    Null doc_ids come first.  Repeated rows are one document; columns of any name may
    stand beside doc_id and text.  An empty table gives an empty result.
    """
    groups = near_groups(docs.select("doc_id", "text"), words, similarity)
    kept = groups.select(*_row_key(F.col("group_doc_id"), F.col("group_hash"))).distinct()
    rows = docs.select(packed(docs).alias("row"), *_row_key(F.col("doc_id"), F.xxhash64("text")))
    return rows.dropDuplicates(["d", "z", "h"]).join(kept, ["d", "z", "h"], "left_semi").select(*unpacked(docs))
