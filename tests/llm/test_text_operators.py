"""Fingerprints, tokens, sentences, secrets and licenses against plain Python and the libraries."""

import hashlib
import re
from pathlib import Path

import public_tokenizers
import pytest

from callweave.llm import fingerprints, licenses, secrets, sentences, tokens

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
STRANGE = ["", " ", "  a  b ", "it's\n\n don't  \t x", "é²½ 中文 😀 ▁▁a", "<|endoftext|>a<|endoftext|> b", "\x1c\x00\x85 z", "ǆʰ ɐ ﬁ", "a" * 3000, "ab\n" * 50]


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def test_token_counts_are_the_librarys(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    got = sorted(map(tuple, tokens.token_counts(odd_docs, BPE).collect()), key=str)
    want = [(i, len(t.encode()), n := len(tokenizer.encode(t, add_special_tokens=False).ids), n > 1024) for i, t in texts(odd_docs)]
    assert got == sorted(want, key=str)
    assert tokens.token_counts(no_docs, BPE).count() == 0
    counter = tokens.PretokenCounter(BPE)
    for text in STRANGE:
        assert counter.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), text


def test_pretokens_of_every_known_character():
    from tokenizers import Tokenizer

    pre, counter = Tokenizer.from_file(BPE).pre_tokenizer, tokens.PretokenCounter(BPE)
    for c in map(chr, [*range(0x2C2), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20C0)]):
        text = f"a{c}1{c}!{c} {c}'{c}s"
        assert counter.pretokens(text) == [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)], repr(c)


def test_sentences_round_trip(spark, odd_docs, no_docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted(map(tuple, sentences.digests(odd_docs, PIECES).collect()), key=str)
    want = [(i, len(ids := model.encode(t)), sha(",".join(map(str, ids))), sha(model.decode(ids))) for i, t in texts(odd_docs)]
    assert got == sorted(want, key=str)
    assert sentences.digests(no_docs, PIECES).count() == 0
    table = sentences.ChunkTable(PIECES)
    for text, (n, ids, decoded) in zip(STRANGE, table.encode_batch(STRANGE), strict=True):
        assert (ids, decoded, n) == (",".join(map(str, model.encode(text))), model.decode(model.encode(text)), len(model.encode(text))), text
    row = sentences.encode(odd_docs.where("doc_id = 5").limit(1), PIECES).first()
    assert row.ids == model.encode(row.row.text) and row.decoded == row.row.text and row.row.ids == "ids"


def pieces_of(text):
    return sorted(p for p in re.split(r"[\n\r]+|(?<=[.!?,;:|]) +", text) if p)


def test_fingerprints_are_of_multisets(spark):
    rows = [(1, "a b. c d.\ne"), (2, "e\nc d. a b."), (3, "a b. c d. c d.\ne"), (4, None), (5, ""), (6, "zz yy. xx")]
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for a, x in rows:
        for b, y in rows:
            assert (got[a] == got[b]) == (pieces_of(x or "") == pieces_of(y or ""))
    both = spark.createDataFrame([(1, "a b. c d.", "e f", "a b. c d.\ne f")], "k int, x string, y string, z string")
    lanes = [fingerprints.lane_sums(both, ["k"], both[c]).withColumnRenamed("lanes", c) for c in "xyz"]
    row = lanes[0].join(lanes[1], "k").join(lanes[2], "k")
    row = row.select((fingerprints.insert(row.x, row.y) == row.z).alias("i"), (fingerprints.delete(row.z, row.y) == row.x).alias("d")).first()
    assert row.i and row.d


def test_edited_texts(spark, odd_docs, no_docs):
    got = sorted((r.n_chars, r.edited_sha256) for r in fingerprints.compare_edited(odd_docs).collect())
    rows = sorted(texts(odd_docs), key=lambda r: (-(r[0] if r[0] is not None else -1), r[1]))
    want = []
    for k, (_, text) in enumerate(rows):
        third, after = len(text) // 3, rows[(k + 1) % len(rows)][1]
        want.append((len(text), hashlib.sha256((text[: len(text) - third] + after[:third]).encode()).hexdigest()))
    assert got == sorted(want)
    found = {r.doc_id: r for r in fingerprints.compare_edited(odd_docs.where("doc_id between 7 and 39")).collect()}
    assert sum(r.near_edited > r.near_next for r in found.values()) >= 0.9 * len(found)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found.values())
    assert fingerprints.compare_edited(no_docs).count() == 0


def brute_lanes(text):
    import xxhash

    sums = [0] * fingerprints.LANES
    for piece in pieces_of(text):
        own = xxhash.xxh64_intdigest(piece.encode(), 42)
        for i in range(fingerprints.LANES):
            h = xxhash.xxh64_intdigest((i // 4).to_bytes(4, "little"), own)
            sums[i] += (h >> 16 * (i % 4) & 65535) - 32768
    return [x % fingerprints.MODULUS for x in sums]


def brute_likeness(a, b):
    signed = lambda v: [x - fingerprints.MODULUS if x >= fingerprints.MODULUS // 2 else x for x in v]
    square = lambda v: sum(x * x for x in signed(v))
    return 1.0 if a == b else max(0.0, 1 - square([(x - y) % fingerprints.MODULUS for x, y in zip(a, b, strict=True)]) / (square(a) + square(b)))


def test_fingerprints_against_brute_force(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "QUANTILES", 3)
    docs = odd_docs.where("doc_id <> 6 or doc_id is null")
    rows = sorted(texts(docs), key=lambda r: (-(r[0] if r[0] is not None else -1), r[1]))
    want = []
    for k, (doc_id, text) in enumerate(rows):
        third, after = len(text) // 3, rows[(k + 1) % len(rows)][1]
        own, edited, other = (brute_lanes(t) for t in (text, text[: len(text) - third] + after[:third], after))
        show = lambda v: "".join(f"{x:08x}" for x in v)
        want.append((doc_id, show(own), show(edited), round(brute_likeness(own, edited), 9), round(brute_likeness(own, other), 9)))
    columns = ("doc_id", "fingerprint", "edited_fingerprint")
    got = [(*[r[c] for c in columns], round(r.near_edited, 9), round(r.near_next, 9)) for r in fingerprints.compare_edited(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def brute_base(text):
    patterns = [r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "AKIA[A-Z0-9]+", "[0-9a-f]+"]
    spans = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text or "", re.I | re.A if k == 0 else 0):
            if len(m[2]) >= 6 if k == 0 else len(m[0]) >= (20, 24)[k - 1]:
                spans.append((m.start(), k, m.end()))
    return sorted(spans)


def secret_texts(odd_docs):
    key = "AKIA" + "Q" * 16
    rows = [(1001, f'a Token = "abcdef12" password:abc {key} {"0f" * 12} {"0f" * 11} api-key=zzzzzz apikey=zzzzzz é{"ab" * 13}'), (1003, "token: token:abcdefgh")]
    rows += [(r.doc_id, r.text) for r in odd_docs.collect()]
    data = Path("/root/testdata/sf0.001/documents.parquet")
    if data.exists():
        import duckdb

        rows += duckdb.sql(f"select doc_id + 2000, text from read_parquet('{data}')").fetchall()
    return rows


def test_secret_base_spans(spark, odd_docs, no_docs):
    rows = secret_texts(odd_docs)
    scanner = secrets.Scanner.trained([], [])
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as kind", "3 as at", "4 as token")
    want = []
    for i, text in rows:
        spans = brute_base(text)
        joined = lambda found: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in found)
        # Candidates by hand: runs cut at equals signs, the first part that the automata take as a whole.
        every = sorted(spans + scanner.more(text or "", spans))
        want.append((i, *[sum(k == j for _, k, _ in spans) for j in range(3)], hashlib.sha256(joined(spans).encode()).hexdigest(), joined(every)))
    got = secrets.report(docs, scanner)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    trained = secrets.report(docs)
    assert trained.columns == got.columns and sorted((r[0], r[4]) for r in trained.collect() if r[0]) == sorted((w[0], w[4]) for w in want if w[0])
    assert secrets.report(no_docs).count() == 0


def brute_likelihood(automaton, token):
    at, total = 0, 0.0
    for c in token:
        s = "d" if c.isdigit() else c if not c.isalpha() else ("h" if c in "abcdef" else "l") if c.islower() else ("H" if c in "ABCDEF" else "U")
        known = automaton[at].get(s)
        total += known[0] if known else secrets.UNSEEN
        at = (known or automaton[0].get(s) or (0, 0))[1]
    return total


def test_candidates_and_scores():
    scanner = secrets.Scanner.trained([], [])
    leak = secrets.labelled_credentials(1, seed=5)[2]
    assert scanner.score(leak) == pytest.approx(brute_likelihood(scanner.credential, leak) - brute_likelihood(scanner.ordinary, leak))
    for text in (f"see {leak} there", f"GH_PAT={leak}", f"https://host.example.com/path/{leak}/more", f"{leak}."):
        at = text.index(leak)
        assert scanner.more(text, []) == [(at, 3, at + len(leak))], text
    assert scanner.more(f"see {leak} there", [(4, 0, 4 + len(leak))]) == []
    assert scanner.more("internationalization of getUserNameFromDatabase at 2024-01-01T00:00:00 in some/long/path.of.words", []) == []
    assert list(secrets.candidates("x=abcdefgh=/ijklmnop.q/ tooshort=")) == [(2, ["abcdefgh"]), (12, ["ijklmnop.q", "ijklmnop"]), (24, ["tooshort"])]


def test_formats_left_out_of_training():
    """Each public format in turn is unknown; ordinary tokens are of another seed."""
    found, taken = {}, 0
    for i, parts in enumerate(secrets.FORMATS):
        scanner = secrets.Scanner.trained([], [], formats=secrets.FORMATS[:i] + secrets.FORMATS[i + 1 :])
        unseen = secrets.labelled_credentials(60, seed=99, formats=(parts,))
        found[parts[0][0]] = sum(map(scanner.takes, unseen)) / len(unseen)
        taken += sum(map(scanner.takes, secrets.ordinary_tokens(20, seed=98)))
    # Formats of digits between dashes alone are not told from numbers; README has the shares.
    assert sum(found.values()) >= 0.8 * len(found), found
    assert taken <= 0.01 * 20 * 25 * len(found)


def test_labels_come_from_the_corpus(spark):
    secret = "zq7" * 9
    rows = [(i, f'word{i} password = "{secret}{i:03d}" ordinarytoken{i}') for i in range(40)]
    scanner = secrets.train(spark.createDataFrame(rows, "doc_id long, text string"))
    plain = secrets.Scanner.trained([], [])
    assert scanner.score(secret + "999") > plain.score(secret + "999")


LOWER = {i: i + 32 for i in range(65, 91)}


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def as_regex(template):
    """The template as a regular expression over words with a blank after each."""
    out, bare = "", re.compile(r"[\[\]|]|<\d+>|[^\s\[\]<>|]+")
    for t in bare.findall(template):
        if t == "[":
            out += "(?:"
        elif t == "]":
            out += ")?"
        elif t == "|":
            out += "|"
        elif t[0] == "<":
            out += f"(?:[^ ]+ ){{0,{t[1:-1]}}}"
        else:
            out += "".join(f"{re.escape(w)} " for w in brute_words(t))
    return re.compile(out)


def brute_licenses(text, regexes):
    words = brute_words(text)
    base = [(i, label) for i in range(len(words)) for phrase, label in licenses.BASE.items() if tuple(words[i : i + len(phrase)]) == phrase]
    joined, at, found = " ".join(words) + " ", 0, []
    for i, word in enumerate(words):
        found += [(i, label) for label, r in regexes if (m := r.match(joined, at)) and m.end() > at]
        at += len(word) + 1
    return len(words), sorted(base), sorted(found)


def whole_license(label):
    template = dict(licenses.TEXTS)[label]
    return re.sub(r"<\d+>", "holders", re.sub(r"\[([^\[\]|]*)(\|[^\[\]]*)?\]", r"\1", template))


def license_texts(odd_docs):
    rows = [(i, "é " + whole_license(label)) for i, (label, _) in enumerate(licenses.TEXTS)]
    rows += [(100, None), (101, "all rights not reserved"), (102, "é all rights reserved"), (102, "é all rights reserved"), (None, "MIT License")]
    rows += [(103, "SPDX-License-Identifier: GPL-2.0-or-later, GNU Lesser General Public License version 2.1 or later; CC0, BSD 3-Clause License")]
    rows += [(r.doc_id, r.text) for r in odd_docs.collect()]
    data = Path("/root/testdata/sf0.001/documents.parquet")
    if data.exists():
        import duckdb

        rows += duckdb.sql(f"select doc_id + 2000, text from read_parquet('{data}')").fetchall()
    return rows


def test_licenses_against_brute_force(spark, odd_docs, no_docs):
    rows = license_texts(odd_docs)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as base", "2 as found", "3 as covered", "4 as n_words")
    regexes = [(label, as_regex(t)) for label, t in licenses.TEMPLATES]
    want = []
    for doc_id, text in rows:
        n, base, found = brute_licenses(text, regexes)
        names = lambda spans: ",".join(sorted({label for _, label in spans}))
        want.append((doc_id, n, len(base), base[0][0] if base else None, base[-1][0] if base else None, names(base), names([*base, *found])))
    got = licenses.report(docs)
    assert sorted((tuple(r)[:7] for r in got.collect()), key=str) == sorted(want, key=str)
    assert got.where("not (score between 0 and 1)").count() == 0 and sum(bool(w[6]) for w in want) > 15
    assert licenses.report(no_docs).count() == 0
    score = {r.doc_id: r.score for r in got.where("doc_id in (100, 102)").collect()}
    assert score == {100: 0.0, 102: 0.75}


@pytest.mark.parametrize("label", [label for label, _ in licenses.TEXTS])
def test_altered_licenses_are_not_accepted(label):
    scanner, text = licenses.LicenseScanner(licenses.TEXTS), whole_license(label)
    found = lambda x: {name for _, name, _ in scanner.scan(brute_words(x))[1]}
    assert label in found(text) and label in found(f"before {text} after")
    words = brute_words(text)
    for at in range(0, len(words), 7):
        if words[at] not in ("holders", "names", "authors", "including", "the", "next", "paragraph", "and", "or", "name", "author") and label != "x11":
            changed = " ".join([*words[:at], "changed", "words", *words[at + 1 :]])
            assert label not in found(changed) or "holders" in words[max(0, at - 12) : at + 13], (label, at, words[at])


@pytest.mark.parametrize(
    ("template", "text", "end"),
    [
        ("a [b [c]] d", "a d x", 2),
        ("a [b [c]] d", "a b c d", 4),
        ("a [b|c] d", "a c d", 3),
        ("a [b|c] d", "a b c d", None),
        ("a <2> d", "a x y d", 4),
        ("a <2> d", "a x y z d", None),
        ("a d", "a d", 2),
        ("a d", "a", None),
    ],
)
def test_template_regions(template, text, end):
    assert licenses.TokenAutomaton(template).longest(text.split(), 0) == end


def test_template_errors():
    for bad in ("[a", "a ]", "[a]", "<3>"):
        with pytest.raises(ValueError):
            licenses.LicenseScanner((("x", bad),))
