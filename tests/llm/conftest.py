import random

import pytest

#: Extra columns with the names that operators use inside.
CLASHES = [f"'{n}' as {n}" for n in ("hash", "row", "site", "at", "x", "m", "d", "h", "gone", "new_text", "removed", "copies", "take", "p", "p_good", "p_content", "ids", "decoded", "content", "metadata", "component", "fps", "_d", "_bad", "id", "words")] + ["1 as size"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, a clashing extra column."""
    made = random.Random(3)
    word = lambda: "".join(made.choices("abcdefghijklmnop", k=made.randint(2, 7)))
    line = lambda n=9: " ".join(word() for _ in range(n)) + "."
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, "x", "en", "a", 1), (4, " \n\t ", "en", "b", 4)]
    rows += [(5, "one two three four five six.\nseven", "en", "a", 33)] * 3
    rows += [(6, line(20_000), "de", None, None), (None, "no id here at all", "en", "b", 17), (None, None, None, None, None)]
    frame = "this frame is on every site."
    for i in range(7, 40):
        body = "\n".join(line() for _ in range(6))
        rows.append((i, f"{frame}\n{body}" if i % 2 else body, "en", f"s{i % 6}", len(body)))
    rows += [(90 + i, rows[12][1], "en", f"s{i}", 1) for i in range(4)]
    docs = spark.createDataFrame(rows, DOCS)
    return docs.selectExpr("*", *CLASHES).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
