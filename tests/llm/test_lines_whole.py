"""Boilerplate goes from every document, and every site of a line counts."""

from callweave.llm import lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_short_pages_lose_their_frame(spark):
    frame = " ".join(f"shared{i}" for i in range(80))
    own = [" ".join(f"own{d}x{i}" for i in range(40)) for d in range(5)]
    docs = spark.createDataFrame([(d, f"{frame}\n{own[d]}", "en", f"s{d}", 1) for d in range(5)], SCHEMA)
    got = {r.row.doc_id: (r.new_text, r.removed) for r in lines.cleaned(docs).collect()}
    assert got == {d: (own[d], 1) for d in range(5)}


def test_all_sites_of_a_line_count(spark):
    line = "one line of several texts"
    rows = [(f"{line}\nown {i} words here", s) for i, other in enumerate("bcde") for s in ("a", other)]
    rows += [("a single text on\nmany sites stays whole", s) for s in "abcdef"]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, (t, s) in enumerate(rows)], SCHEMA)
    assert [(r.sites, r.boilerplate) for r in lines.spread(docs, texts=2).where("rows = 8").collect()] == [(5, True)]
    got = {r.row.doc_id: r.removed for r in lines.cleaned(docs, texts=2).collect()}
    assert got == {i: int(i < 8) for i in range(14)}
    plain = {r.row.doc_id: r.removed for r in lines.cleaned(docs).collect()}
    assert plain == {i: 1 if i < 8 else 2 for i in range(14)}
