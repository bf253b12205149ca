"""The pipeline's near-duplicates: candidates come from chains of segments, and none that is similar is lost."""

import random

import numpy as np
import pytest

from callweave.llm import simhash


def rows_of(sets, hot, similarity=0.8):
    """What ``chain_rows`` makes of sets, each as columns."""
    out = []
    for s in sets:
        found = simhash._profile(s, similarity)
        for keys, chains, m in simhash._starts(found["n"], found["rings"], similarity, hot):
            out.append((found["n"], keys, chains, m))
    return out


def met(a, b, hot=np.zeros(0, np.int64), similarity=0.8):
    """(pairs of rows with equal starts, those within the budgets of their chains)."""
    pairs = [(r, i, s, j) for r in rows_of([a], hot) for s in rows_of([b], hot) for i, key in enumerate(r[1]) for j in np.flatnonzero(s[1] == key)]
    if not pairs:
        return 0, 0
    columns = {
        "n": np.array([x for r, _, s, _ in pairs for x in (r[0], s[0])], np.int32),
        "m": np.array([x for r, _, s, _ in pairs for x in (r[3], s[3])], np.int32),
        "chain": np.array([x for r, i, s, j in pairs for x in (r[2][i], s[2][j])], np.int64),
    }
    at = np.arange(0, 2 * len(pairs), 2)
    return len(pairs), int(simhash._within_chains(columns, at, at + 1, similarity).sum())


def pair(made, n, similarity):
    """Two sorted sets, the larger of ``n``, at ``similarity`` or the next possible one above."""
    other = made.integers(int(np.ceil(similarity * n - 1e-9)), n + 1)
    both = min(other, int(np.ceil(similarity * (n + other) / (1 + similarity) - 1e-9)))
    pool = made.integers(0, 1 << 63, 2 * n, dtype=np.uint64) << np.uint64(1)
    return np.unique(pool[:n]), np.unique(np.r_[pool[:both], pool[n : n + other - both]])


@pytest.mark.parametrize("share_of_hot", [0.0, 0.5, 0.95, 1.0])
def test_similar_sets_meet_within_their_chains(share_of_hot):
    made = np.random.default_rng(5)
    for n in [*range(4, 40), 60, 100, 171, 400, 1500] * 6:
        a, b = pair(made, n, 0.8)
        if np.array_equal(a, b):
            continue
        keys = np.concatenate([r[1] for r in rows_of([a, b], np.zeros(0, np.int64))])
        hot = np.unique(made.choice(keys, int(share_of_hot * len(keys)), replace=False))
        assert met(a, b, hot)[1], (n, len(a), len(b))


def test_chains_turn_away_what_only_shares_a_start():
    made, shared, kept = np.random.default_rng(6), 0, 0
    for _ in range(100):
        a, b = pair(made, 400, 0.3)
        one, two = met(a, b)
        shared, kept = shared + one, kept + two
    assert shared > 200 and kept < shared / 10, (shared, kept)


def test_near_copy_with_an_unlikely_fingerprint_is_found(spark):
    """Words are added so that as many of 128 fingerprint bits as possible change: no bound on them may decide."""
    made = random.Random(8)
    words = [f"w{made.randint(0, 10**6)}" for _ in range(124)]
    known = simhash._hashes(words, 5)
    first = np.array(simhash.majority(known, 2)).view(np.uint64)
    ends = lambda h: np.concatenate([np.unpackbits(simhash._mixed(h, i).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1) for i in (0, 1)], 1).astype(int)
    sign = np.where(ends(known).sum(0) * 2 > len(known), 1, -1)
    lead, more = sign * (2 * ends(known).sum(0) - len(known)), list(words)
    for _ in range(30):
        options = [f"x{made.randint(0, 10**6)}" for _ in range(300)]
        steps = [sign * (2 * ends(simhash._hashes([*more[-4:], o], 5))[0] - 1) for o in options]
        # Bits that the added words can still turn count.
        best = min(range(300), key=lambda i: np.where(np.abs(lead) < 14, lead + steps[i], 0).clip(-2, None).sum())
        more.append(options[best])
        lead = lead + steps[best]
    a, b = (np.unique(simhash._hashes(w, 5)) for w in (words, more))
    second = np.array(simhash.majority(b, 2)).view(np.uint64)
    assert len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) and np.bitwise_count(first ^ second).sum() > 40
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(more)), (3, "another text that is alone here")], "doc_id long, text string")
    assert {r.doc_id: r.group_doc_id for r in simhash.near_groups(docs).collect()} == {1: 1, 2: 1, 3: 3}
