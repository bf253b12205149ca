"""Quality, mixing, lines, near-duplicates, top-k and the pipeline against brute force on small tables."""

import random
import re
from collections import Counter, defaultdict
from itertools import groupby
from pathlib import Path

import numpy as np
import pytest
import xxhash

from callweave.llm import components, lines, mixing, quality, simhash, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


class Sets:
    def __init__(self):
        self.up = {}

    def top(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


# Components and SimHash


@pytest.mark.parametrize("hub", [500, 3])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(components, "HUB", hub)
    made = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(made.randint(100, 180), made.randint(100, 180)) for _ in range(60)] + [(7, 7), (200, 201), (201, 200)]
    pairs += [(300, 301 + i) for i in range(30)] + [(315, 400 + i) for i in range(20)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == partition(pairs, {x for p in pairs if p[0] != p[1] for x in p})
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most, group", [(1, 4096), (3, 4096), (3, 5)])
def test_links_lose_none(spark, monkeypatch, most, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    made, seen = random.Random(2), set()
    for _ in range(60):
        base = made.getrandbits(64)
        for _ in range(12):
            x = base
            for bit in made.sample(range(64), made.randint(0, 5)):
                x ^= 1 << bit
            seen.add(x)
    rows = sorted(x - (1 << 64) if x >> 63 else x for x in seen)
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in rows], "fp long"), most).collect()]
    bits = np.array(rows, np.int64).view(np.uint64)
    want = [(rows[i], rows[j]) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(bits[i] ^ bits) <= most) if i < j]
    assert {tuple(sorted(p)) for p in got} <= set(want) and len(want) > 100
    assert partition(got, rows) == partition(want, rows)


def partition(pairs, nodes):
    sets = Sets()
    for a, b in pairs:
        sets.join(a, b)
    return {x: sets.top(x) for x in nodes}


def fingerprint(text, n=3):
    words = WORD.findall(lower(text))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_report(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.where("doc_id <> 6 or doc_id is null").collect()]
    docs = odd_docs.where("doc_id <> 6 or doc_id is null")
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    prints = [fingerprint(t) for _, t in rows]
    sets = Sets()
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                sets.join(i, j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[sets.top(i)].append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    assert got == Counter((d, f"{p:016x}", least[sets.top(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True)))
    assert simhash.near_duplicates(no_docs).count() == 0


def shingles(text, n=5):
    words = WORD.findall(lower(text))
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} or ({" ".join(words)} if words else set())


def near_copies(count, seed=4):
    made = random.Random(seed)
    vocabulary = ["".join(made.choices("abcdefgh", k=5)) for _ in range(400)]
    rows, doc_id = [], 0
    for g in range(count):
        words = made.choices(vocabulary, k=120)
        for c in range(made.randint(1, 6) if g else 40):
            own = list(words)
            for _ in range(made.choice((0, 1, 1, 2, 8))):
                own[made.randrange(120)] = "edit" + str(made.randint(0, 99))
            rows.append((doc_id, " ".join(own), "en", f"s{c}", 1))
            doc_id += 1
    return rows


def brute_groups(known, similarity=0.8):
    """Least doc_id reachable over similar pairs, for every doc_id."""
    holders, sets = defaultdict(list), Sets()
    for a, own in known.items():
        sets.top(a)
        for b in {b for x in own for b in holders[x]} if own else [b for b in known if b < a and not known[b]]:
            both = len(own & known[b])
            if both >= similarity * len(own | known[b]):
                sets.join(a, b)
        for x in own:
            holders[x].append(a)
    return {a: sets.top(a) for a in known}


@pytest.mark.parametrize("group, hot", [(4096, 1000), (6, 10)])
def test_near_groups(spark, monkeypatch, group, hot):
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rows = near_copies(40)
    made = random.Random(11)
    # Short texts: 4 shingles against 5, and up to 30; a passage that many share.
    for n in [8, 8, 9, 12, 16, 24, 34] * 12:
        words = [f"w{made.randint(0, 10**6)}" for _ in range(n)]
        for text in (words, [*words, "more"], ["else", *words[1:]]):
            rows.append((len(rows), " ".join(text), "en", "s", 1))
    passage = " ".join(f"common{i}" for i in range(40))
    rows += [(len(rows) + i, passage + " " + " ".join(f"own{i}x{j}" for j in range(made.randint(2, 60))), "en", "s", 1) for i in range(50)]
    docs = spark.createDataFrame(rows, odd_schema())
    got = {r.doc_id: r.group_doc_id for r in simhash.near_groups(docs).collect()}
    want = brute_groups({r[0]: shingles(r[1]) for r in rows})
    assert got == want and len(set(want.values())) < len(want) - 100
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(got.values())


def test_near_groups_of_odd_tables(spark, odd_docs, no_docs):
    odd = simhash.dedup(odd_docs)
    assert odd.dtypes == odd_docs.dtypes
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    places = brute_groups({i: shingles(t) for i, (_, t) in enumerate(rows)})
    least = {}
    for i, g in places.items():
        least[g] = min(least.get(g, rows[i]), rows[i], key=lambda r: (r[0] is not None, r[0] or 0))
    assert Counter(r.doc_id for r in odd.collect()) == Counter(d for d, _ in least.values())
    assert simhash.dedup(no_docs).count() == 0


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 5)
    rows = [(i, 1, [*range(100), 1000 + i]) for i in range(30)] + [(50 + i, 2, list(range(i * 100, i * 100 + 100))) for i in range(12)]
    wide = lambda s: simhash.majority(np.array(s, np.uint64) * np.uint64(0x9E3779B97F4A7C15), simhash.WIDE_LONGS)
    numbers = lambda x: bytearray(np.array(x, np.int64).tobytes())
    rows = [(i, c, numbers(s), numbers(wide(s))) for i, c, s in rows]
    found = simhash.exact_links(spark.createDataFrame(rows, "id long, component long, shingles binary, wide binary"), 0.8).collect()
    assert len(set(partition([(r.a, r.b) for r in found], range(30)).values())) == 1 and all(r.a < 50 for r in found)


# Lines


def brute_lines(rows, sites=4, words=1, texts=1):
    """(doc_id, new text, removed) of (doc_id, text, source) rows."""
    spread, holders = defaultdict(set), defaultdict(set)
    bare = lambda x: x.strip(" \t\n\v\f\r")
    for _, text, source in rows:
        for line in (text or "").split("\n"):
            if len(WORD.findall(line)) >= words:
                spread[bare(line)].add(source)
                holders[bare(line)].add(text)
    out = []
    for doc_id, text, _ in rows:
        bad = lambda x: len(spread[bare(x)]) >= sites and len(holders[bare(x)]) >= texts
        kept = [x for x in (text or "").split("\n") if not bad(x)]
        out.append((doc_id, None if text is None else "\n".join(kept), len((text or "").split("\n")) - len(kept)))
    return out


@pytest.mark.parametrize("texts", [1, 2])
@pytest.mark.parametrize("words, most", [(1, 1_000_000), (3, 0)])
def test_line_dedup(spark, odd_docs, no_docs, monkeypatch, words, most, texts):
    monkeypatch.setattr(lines, "MOST_BROADCAST", most)
    out = lines.cleaned(odd_docs, words=words, texts=texts).select("row.doc_id", "new_text", "removed")
    rows = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    want = brute_lines(rows, words=words, texts=texts)
    assert Counter(map(tuple, out.collect())) == Counter(want) and sum(n for _, _, n in want) > 20
    whole = lines.dedup(odd_docs, words=words, texts=texts)
    assert whole.dtypes == odd_docs.dtypes
    assert Counter((r.doc_id, r.text, r.row) for r in whole.collect()) == Counter((d, t, "row") for d, t, _ in want)
    assert lines.dedup(no_docs).count() == 0


def test_spread_estimates(spark):
    rows = [(i, "a line on very many sites", "en", f"s{i}", 1) for i in range(300)] + [(1000 + i, f"text {i}\na line on some sites", "en", f"s{i % 3}", 1) for i in range(30)]
    rows = [(i, f"{t}\nown {i} words here", lang, s, n) for i, t, lang, s, n in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.rows: (r.sites, r.boilerplate) for r in lines.spread(docs).where("rows > 1").collect()}
    assert got[30] == (3, False) and got[300][1] and abs(got[300][0] - 300) <= 30


def test_adjacent_lines_and_blank_ones(spark):
    rows = [(i, f"head {i}\nframe one\nframe two\n\n \nbody {i}\nframe one\n", "en", f"s{i}", 1) for i in range(5)]
    got = {r.row.doc_id: (r.new_text, r.removed) for r in lines.cleaned(spark.createDataFrame(rows, odd_schema())).collect()}
    assert got == {i: (f"head {i}\n\n \nbody {i}\n", 3) for i in range(5)}


def odd_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


# Mixing


def water_fill(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return target


def test_mix_report(spark, odd_docs, no_docs):
    made = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(int(made.paretovariate(1.2) * 5))), "en", made.choice(["a", "B", "é", None, "c", "a", "a"]), 1) for i in range(1500)]
    docs = spark.createDataFrame(rows, odd_docs.select("doc_id", "text", "lang", "source", "n_chars").schema).unionByName(odd_docs.select("doc_id", "text", "lang", "source", "n_chars"))
    got = mixing.report(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in docs.collect())
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want, taken, largest = water_fill(sizes), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.1 * want[s] + largest[s]
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.report(docs.repartition(7)).collect()))
    assert mixing.report(no_docs).count() == 0


def test_mixed_corpus_has_the_copies(spark, odd_docs, no_docs):
    docs = odd_docs
    mixed = mixing.mix(docs)
    assert mixed.dtypes == docs.dtypes and mixing.mix(no_docs).count() == 0
    want = sum((Counter({(r.doc_id, r.source, r.size): r.copies}) for r in mixing.copies(mixing.sized(docs)).collect()), Counter())
    got = Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in mixed.collect())
    assert got == +want


def test_reduction_tree_keeps_sums(spark):
    rows = [(i, "a" if i % 3 else "b", 10) for i in range(5000)]
    found = mixing.copies(spark.createDataFrame(rows, "doc_id long, source string, size long")).groupBy("source").agg({"copies": "sum", "target": "max", "size": "max"}).collect()
    for r in found:
        assert abs(r["sum(copies)"] - r["max(target)"] / 10) <= 1


# Top-k


def brute_top(rows, k=5):
    good = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in x]) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for q, x in good:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in good if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def vectors_to_search():
    made = np.random.default_rng(6)
    rows = [(i, made.normal(size=12).tolist()) for i in range(400)]
    rows += [(400 + i, rows[50][1]) for i in range(60)]
    return [*rows, (500, None), (501, [1.0, None]), (502, [float("nan")] * 12), (503, [float("inf")] * 12), (None, [9.0] * 12), (550, [0.0] * 12), (600, []), (650, [1e6] * 12)]


@pytest.mark.parametrize("nodes, kept", [(2, 16), (3, 1), (1, 2)])
def test_top_k(spark, monkeypatch, nodes, kept):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "KEPT", kept)
    monkeypatch.setattr(topk, "NODES", nodes)
    rows = vectors_to_search()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as x", "3 as node")
    got = sorted(map(tuple, topk.search(frame).collect()))
    assert got == brute_top(rows)


def test_top_k_of_odd_tables(spark):
    rows = vectors_to_search()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert topk.search(frame.limit(0)).count() == 0
    few = frame.where("vec_id in (0, 1, 2)")
    assert sorted(map(tuple, topk.search(few).collect())) == brute_top(rows[:3])
    # Repeated rows are candidates each; a query's own rows are none.
    twice = topk.search(frame.where("vec_id < 60").union(frame.where("vec_id in (0, 7, 7)")))
    want = []
    for q, group in groupby(brute_top(rows[:60], 60), key=lambda r: r[0]):
        entries = [r for r in group for _ in range(2 if r[2] in (0, 7) else 1)]
        want += [(q, n + 1, r[2], r[3]) for n, r in enumerate(entries[:5])]
    assert sorted(map(tuple, twice.collect())) == want


def test_nodes_send_only_what_the_cutoff_asks_for(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 256)
    made = np.random.default_rng(8)
    rows = [(i, made.normal(size=16).tolist()) for i in range(2000)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    search = topk.Search(vectors, vectors.where("vec_id % 50 = 0"), 5)
    pairs = 2000 * 40
    assert search.entries.count() < 0.1 * topk.NODES * pairs and search.open.count() < search.entries.count()
    told = search.entries.join(search.cutoffs, "qid")
    assert told.where("score < part").count() == 0
    # All entries at or above the cutoff's part were sent, from lists or by a second scan.
    x = np.array([v.x for v in search.classes.orderBy("id").collect()])
    ids = [v.id for v in search.classes.orderBy("id").collect()]
    parts = {r.qid: r.part for r in search.cutoffs.collect()}
    sent = {(r.qid, r.id, r.node) for r in search.entries.collect()}
    for q in search.queries.collect():
        for node, (a, n) in enumerate(topk._columns(16)):
            scores = x[:, a : a + n] @ np.array(q.x)[a : a + n]
            assert all((q.qid, ids[i], node) in sent for i in np.flatnonzero(scores >= parts[q.qid]))


# Quality


def labelled(spark, n=400, seed=7):
    made = random.Random(seed)
    word = lambda: "".join(made.choices("abcdefghijklmnop", k=made.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(made.randint(20, 120))]
        good = i % 5 != 0
        text = " ".join(words).capitalize() + "." if good else made.choice((" ".join(f"{w.upper()}!!" for w in words), " | ".join(words), " ".join([words[0]] * 40)))
        rows.append((i, text, "en", f"s{i % 7}", len(text)))
        if i % 2:
            labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_held_out(spark, odd_docs, no_docs):
    docs, labels = labelled(spark)
    got = {r.doc_id: r.keep for r in quality.classify(docs, labels).collect()}
    unlabelled = [i for i in got if i % 2 == 0]
    assert np.mean([got[i] == (i % 5 != 0) for i in unlabelled]) >= 0.95
    assert len(got) == 400 and quality.keep_good(docs, labels).columns == docs.columns
    assert quality.classify(odd_docs, labels).count() == odd_docs.count()
    assert quality.classify(no_docs, labels).count() == 0
    assert all(r.keep for r in quality.classify(docs, labels.limit(0)).collect())


def test_views_exchange_labels(spark):
    docs, labels = labelled(spark)
    found = quality.features(docs).cache()
    model, alone = quality.train(found, labels), quality.train(found, labels, rounds=0)
    assert alone.exchanged == [0, 0] and model.exchanged[1] > 20  # the content view taught the metadata view
    # What the views give each other is what they are sure of, over all unlabelled documents and no others.
    assert max(model.exchanged) <= docs.count() - labels.count()


def test_gradient_sums_are_those_of_all_documents(spark):
    docs, labels = labelled(spark, 120)
    found = quality.features(docs)
    rows = found.collect()
    x = [np.stack([np.frombuffer(r[c], "<f4").astype(float) for r in rows]) for c in ("content", "metadata")]
    made = np.random.default_rng(3)
    fit = lambda v: quality.Logistic(v.mean(0), v.std(0) + 1e-3, made.normal(size=v.shape[1] + 1))
    models = [fit(v) for v in x]
    teachers = [[quality.Teacher(fit(v), 2.0, 5.0), quality.Teacher(fit(v), 0.5, 0.5)] for v in x]
    got = quality._pass(found.repartition(5), teachers, models)
    for v in (0, 1):
        given = teachers[1 - v][0].labels(x[1 - v])
        given = np.where(np.isnan(given), teachers[1 - v][1].labels(x[1 - v]), given)
        z = np.hstack([(x[v] - models[v].mean) / models[v].scale, np.ones((len(rows), 1))])
        for label in (0, 1):
            at = given == label
            error = quality._sigmoid(z[at] @ models[v].weights) - label
            assert np.allclose(got[v][label], np.append(z[at].T @ error, at.sum())) and at.any()


def test_sureness_follows_from_precision():
    odds = np.arange(400, 0, -1.0)
    right = np.array([True] * 200 + [False] + [True] * 3 + [False] * 196)
    worst = np.zeros(400, bool)
    assert 190 < quality._sure_from(odds, right, worst) < 201 and quality._sure_from(odds, ~right, worst) == np.inf
    right[2] = False
    assert quality._sure_from(odds, right, ~worst) == np.inf  # a perfect pupil learns nothing from a teacher that errs
    few = np.array([True] * 12 + [False] * 4)
    assert quality._sure_from(odds[:16], few, np.zeros(16, bool)) == np.inf  # no errors, but four documents to make them on


def auc(labels, scores):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    good = (labels > 0).sum()
    return (ranks[labels > 0].sum() - good * (good + 1) / 2) / (good * (len(labels) - good))


def test_exchange_on_real_labels(spark):
    """A third of the labels of the small tables is kept out; README has the figures."""
    folder = "/root/testdata/sf0.01"
    if not Path(folder).exists():
        pytest.skip("needs the test tables")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    kept_out = "pmod(xxhash64(doc_id), 3) = 0"
    found = quality.features(docs).cache()
    rows = found.join(labels.where(kept_out), "doc_id").collect()
    known = np.array([r.quality for r in rows])
    x = [np.stack([np.frombuffer(r[c], "<f4").astype(float) for r in rows]) for c in ("content", "metadata")]
    scores = {}
    for rounds in (0, quality.ROUNDS):
        model = quality.train(found, labels.where(f"not ({kept_out})"), rounds)
        scores[rounds] = [round(auc(known, p), 3) for p in model.probability(*x)]
    print("AUC both, content, metadata without and with exchange:", scores)
    assert scores[quality.ROUNDS][0] >= 0.97 and scores[quality.ROUNDS][0] >= scores[0][0] - 0.01


# Pipeline


def pipeline_tables(spark, folder):
    """Good and bad documents with frames, copies, near copies, nulls, empty texts and repeated rows."""
    docs, labels = labelled(spark, 150)
    rows = [tuple(r) for r in docs.collect()]
    frame = "a frame that many pages have at their head"
    rows = [(d, f"{frame}\n{t}" if d % 4 == 0 else t, lang, source, n) for d, t, lang, source, n in rows]
    rows += [(200 + i, rows[7][1], "en", f"s{i % 7}", 1) for i in range(6)]
    rows += [(300 + i, rows[11][1] + f" more{i}", "en", f"s{i % 7}", 1) for i in range(6)]
    rows += [(1000, None, "en", "s1", None), (1001, "", None, None, 0), (1002, "  ", "en", "s2", 2), (None, "no id here but some words", "en", "s3", 5)]
    rows += [rows[13]] * 2
    spark.createDataFrame(rows, odd_schema()).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import hashlib

    import corpus_pipeline
    import public_tokenizers
    import sentencepiece

    folder = str(tmp_path)
    pipeline_tables(spark, folder)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mix", "tokens"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder)
        if name != "tokens":
            assert after.dtypes == docs.dtypes
        after.write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        steps.append((name, [tuple(r) for r in docs.collect()], [tuple(r) for r in after.collect()]))
        docs = after
    stages = {name: (before, after) for name, before, after in steps}
    # Quality: the scores of the report decide, row by row.
    before, after = stages["quality"]
    keep = {r.doc_id: r.keep for r in quality.classify(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert Counter(after) == Counter(r for r in before if keep[r[0]]) and 0 < len(after) < len(before)
    # Lines.
    before, after = stages["lines"]
    want = [(d, t, *b[2:4], len(t or "")) for b, (d, t, _) in zip(before, brute_lines([(r[0], r[1], r[3]) for r in before], texts=2), strict=True)]
    assert Counter(after) == Counter(want) and after != before
    # Near duplicates: the least doc_id of each group, null first.
    before, after = stages["near_duplicates"]
    rows = sorted(set(before), key=lambda r: (r[0] is not None, r[0] or 0))
    groups = brute_groups({i: shingles(r[1]) for i, r in enumerate(rows)})
    assert Counter(r[:2] for r in after) == Counter(rows[g][:2] for g in set(groups.values())) and len(after) < len(before) - 10
    # Mix: nothing but whole copies of its input, two at most, and each source near its target.
    before, after = stages["mix"]
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in before:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
        most[r[3]] = max(most[r[3]], len(WORD.findall(r[1] or "")))
    for r in after:
        taken[r[3]] += len(WORD.findall(r[1] or ""))
    copies = Counter(after)
    assert copies.keys() <= set(before) and all(n <= 2 * Counter(before)[r] for r, n in copies.items())
    for source, target in water_fill(dict(sizes)).items():
        assert abs(taken[source] - target) <= 0.1 * target + most[source]
    # Tokens: the library's.
    before, after = stages["tokens"]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(r[0], len(ids := model.encode(r[1] or "")), sha(",".join(map(str, ids))), sha(model.decode(ids) if ids else "")) for r in before]
    assert Counter(after) == Counter(want)
    # All at once.
    whole = corpus_pipeline.run(spark, folder)
    assert Counter(map(tuple, whole.collect())) == Counter(after)


def test_pipeline_of_an_empty_table(spark, odd_docs, tmp_path):
    import corpus_pipeline

    odd_docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
