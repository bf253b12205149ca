"""License scans: template markup compiled to token automata.

A template is wording with optional and replaceable regions:

* plain words are mandatory and must match exactly;
* ``[ ... ]`` may be left out, and may hold further regions;
* ``<n>`` stands for up to ``n`` words of any kind (names, years, list marks).

It is compiled to an automaton over words, with epsilon moves around optional regions
and a counted loop for replaceable ones; a text has the license where the automaton
accepts a run of its words.  Runs are tried only where a word occurs that can begin
a template, so a scan reads each text once.  Beside this the base phrases are found.

Templates go to the end of a license's wording, so that one with an altered condition or
disclaimer is not accepted; the notices that licenses ask for, their names and SPDX lines
are templates with labels of their own.  Texts are scanned whole where they are; nothing
is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import arrow_map
from callweave.llm.license_texts import IDENTIFIERS, NOTICES, TEXTS

# The base phrases and their labels.
BASE = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}

#: Templates by label; several may share one.  A whole text has the license's own label, a notice or a name ``notice:`` before it.
TEMPLATES: tuple[tuple[str, str], ...] = (
    *TEXTS,
    *[(f"notice:{label}", template) for label, template in NOTICES],
    *[(f"spdx:{name.lower()}", f"spdx license identifier {name} [only|or later]") for name in IDENTIFIERS],
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARKUP = re.compile(r"[\[\]|]|<\d+>|[^\s\[\]<>|]+")

_LOWER = {i: i + 32 for i in range(65, 91)}


def words_of(text: str) -> list[str]:
    """Words of a text, A-Z lower-cased."""
    return _WORD.findall(text.lower() if text.isascii() else text.translate(_LOWER))


class TokenAutomaton:
    """One template as states with moves by word, by any word, and by nothing."""

    def __init__(self, template: str):
        self.by_word: list[dict[str, int]] = []
        self.by_any: list[int | None] = []
        self.free: list[list[int]] = []
        tokens = _MARKUP.findall(template)
        start = self._state()
        self.accepting, rest = self._sequence(tokens, 0, start)
        if rest != len(tokens):
            raise ValueError(f"unbalanced markup: {template}")
        self.start = self._closure({start})
        if self.accepting in self.start:
            raise ValueError(f"no mandatory wording: {template}")

    def _state(self) -> int:
        self.by_word.append({})
        self.by_any.append(None)
        self.free.append([])
        return len(self.free) - 1

    def _sequence(self, tokens: list[str], i: int, at: int) -> tuple[int, int]:
        """Compile up to a closing bracket or bar; gives the last state and the place after."""
        while i < len(tokens) and tokens[i] not in "]|":
            t = tokens[i]
            if t == "[":
                end = self._state()
                self.free[at].append(end)
                while t in "[|":
                    branch = self._state()
                    self.free[at].append(branch)
                    last, i = self._sequence(tokens, i + 1, branch)
                    self.free[last].append(end)
                    if i == len(tokens):
                        raise ValueError("an optional region is not closed")
                    t = tokens[i]
                at = end
            elif t[0] == "<":
                end = self._state()
                for _ in range(int(t[1:-1])):
                    self.free[at].append(end)
                    after = self._state()
                    self.by_any[at] = after
                    at = after
                self.free[at].append(end)
                at = end
            else:
                for word in words_of(t):
                    after = self._state()
                    self.by_word[at][word] = after
                    at = after
            i += 1
        return at, i

    def _closure(self, states: set[int]) -> frozenset[int]:
        stack = list(states)
        while stack:
            for s in self.free[stack.pop()]:
                if s not in states:
                    states.add(s)
                    stack.append(s)
        return frozenset(states)

    def first_words(self) -> set[str]:
        return {w for s in self.start for w in self.by_word[s]}

    def second_words(self, first: str) -> frozenset[str] | None:
        """Words that may follow the first one; None if any may, or none need."""
        after = self._closure({t for s in self.start if (t := self.by_word[s].get(first)) is not None})
        if self.accepting in after or any(self.by_any[s] is not None for s in after):
            return None
        return frozenset(w for s in after for w in self.by_word[s])

    def longest(self, words: list[str], at: int) -> int | None:
        """End of the longest accepted run of words from ``at``, or None."""
        now, end = self.start, None
        while now and at < len(words):
            word = words[at]
            then = {s for x in now if (s := self.by_word[x].get(word)) is not None} | {s for x in now if (s := self.by_any[x]) is not None}
            now = self._closure(then)
            at += 1
            if self.accepting in now:
                end = at
        return end


class LicenseScanner:
    """Base places and template matches of a list of words."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.templates = [(label, TokenAutomaton(t)) for label, t in templates]
        self.by_first: dict[str, list[tuple[str, TokenAutomaton, frozenset[str] | None]]] = {}
        for label, automaton in self.templates:
            if any(automaton.by_any[s] is not None for s in automaton.start):
                raise ValueError("a template must begin with a word")
            for word in automaton.first_words():
                self.by_first.setdefault(word, []).append((label, automaton, automaton.second_words(word)))
        self.phrases: dict[str, list[tuple[tuple[str, ...], str]]] = {}
        for phrase, label in BASE.items():
            self.phrases.setdefault(phrase[0], []).append((phrase, label))
        self.anchors = self.by_first.keys() | self.phrases.keys()

    def scan(self, words: list[str]) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
        """(start, label, end) of the base phrases and of the longest run of each template from each place."""
        base, more = [], []
        anchors = self.anchors
        for at in [i for i, w in enumerate(words) if w in anchors]:
            for phrase, label in self.phrases.get(words[at], ()):
                if tuple(words[at : at + len(phrase)]) == phrase:
                    base.append((at, label, at + len(phrase)))
            after = words[at + 1] if at + 1 < len(words) else ""
            for label, automaton, second in self.by_first.get(words[at], ()):
                if (second is None or after in second) and (end := automaton.longest(words, at)) is not None:
                    more.append((at, label, end))
        return base, more


def covered(spans: list[tuple[int, str, int]]) -> int:
    """Number of words in at least one span."""
    total, upto = 0, 0
    for a, _, b in sorted(spans):
        total += max(0, b - max(a, upto))
        upto = max(upto, b)
    return total


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, base, found, covered) for every row of ``docs`` (doc_id, text).

    ``base`` and ``found`` are arrays of (start, label, end) in words, the end
    exclusive: base phrases, and accepted runs of templates; ``covered`` is the number
    of words in any.  A null text counts as empty; repeated rows are scanned each, null
    doc_ids stay null, other columns take no part, an empty table gives an empty result.
    """
    scanner = LicenseScanner(templates)

    def work(rows: dict) -> dict:
        out = {"doc_id": rows["doc_id"], "n_words": [], "base": [], "found": [], "covered": []}
        for text in rows["text"]:
            words = words_of(text or "")
            base, more = scanner.scan(words)
            out["n_words"].append(len(words))
            out["covered"].append(covered([*base, *more]))
            for name, spans in (("base", base), ("found", more)):
                out[name].append([{"start": a, "label": x, "end": b} for a, x, b in spans])
        return out

    spans = "array<struct<start:long,label:string,end:long>>"
    return arrow_map(docs.select("doc_id", "text"), work, f"doc_id long, n_words long, base {spans}, found {spans}, covered long")


def report(docs: DataFrame) -> DataFrame:
    """The op9 report: base places and labels, all labels, and the share of words in licensing wording, for every row as ``scan`` has it."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    starts = F.transform("base", lambda s: s["start"])
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", "found")).alias("labels"),
        F.when(F.col("n_words") > 0, F.col("covered") / F.col("n_words")).otherwise(0.0).alias("score"),
    )
