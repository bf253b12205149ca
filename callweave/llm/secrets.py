"""Secret scans: base patterns, and formats learned by grammar inference.

Labelled tokens come from the corpus: what the base patterns find in a bounded sample of
documents are credentials, other tokens of the sample are ordinary.  Specimens of public
formats and of common kinds of ordinary tokens, made by rule, are added, so that a
corpus without secrets has labels too.  Each class is put into a prefix tree over
classes of characters; statistically compatible states are merged (ALERGIA: red and blue
states, Hoeffding tests) into a probabilistic automaton.  Every candidate token of every
text is scored by how much likelier the credentials' automaton makes its format than the
ordinary one.

The automata are small, trained on the driver from at most ``MOST_LABELLED`` tokens of
each class, and travel with the task.  Texts are scanned whole where they are; nothing
of the corpus but the sample is shuffled.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import arrow_map, cut

KINDS = ("assign", "access", "hex", "format")
#: Specimens of each format or kind, and the level of the test that keeps states apart.
SAMPLES, ALPHA = 120, 0.05
#: Documents that labels are taken from, with base spans and at large; tokens of each class; all by least hash.
MOST_DOCUMENTS, MOST_LABELLED = 1_000, 2_000
#: A candidate has so many characters; it is taken from so much log-likelihood in favour, in all and per character.
LENGTH, TOTAL, EACH = 8, 16.0, 0.8

# The base patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_ANY_BASE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")

_ALNUM, _UPPER, _BASE64 = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "-_"
# Public credential formats, as (prefix, alphabet, length) parts.
FORMATS = (
    (("AKIA", _UPPER, 16),),
    (("ASIA", _UPPER, 16),),
    (("ghp_", _ALNUM, 36),),
    (("gho_", _ALNUM, 36),),
    (("ghs_", _ALNUM, 36),),
    (("glpat-", _BASE64, 20),),
    (("npm_", _ALNUM, 36),),
    (("xoxb-", string.digits, 12), ("-", string.digits, 12), ("-", _ALNUM, 24)),
    (("xoxp-", string.digits, 12), ("-", string.digits, 12), ("-", _ALNUM, 24)),
    (("AIza", _BASE64, 35),),
    (("sk_live_", _ALNUM, 24),),
    (("rk_live_", _ALNUM, 24),),
    (("SG.", _BASE64, 22), (".", _BASE64, 43)),
    (("eyJ", _BASE64, 33), (".eyJ", _BASE64, 60), (".", _BASE64, 43)),
)


def labelled_credentials(n: int = SAMPLES, seed: int = 7, formats: tuple = FORMATS) -> list[str]:
    """``n`` specimens of every format."""
    made = random.Random(seed)
    return ["".join(p + "".join(made.choices(a, k=k)) for p, a, k in parts) for parts in formats for _ in range(n)]


def ordinary_tokens(n: int = SAMPLES, seed: int = 8) -> list[str]:
    """``n`` of each kind of long token that is no credential: words, names, numbers, identifiers, paths, hosts, versions, dates."""
    made = random.Random(seed)
    word = lambda k=0: "".join(made.choices(string.ascii_lowercase, k=k or made.randint(3, 8)))
    number = lambda k: "".join(made.choices(string.digits, k=k))
    kinds = (
        *[lambda: word(made.randint(16, 30)) + made.choice(("", "."))] * 6,
        *[lambda: word(made.randint(16, 30)).capitalize() + made.choice(("", "."))] * 3,
        *[lambda: word(made.randint(16, 30)).upper() + made.choice(("", "."))] * 3,
        lambda: "-".join(word() for _ in range(made.randint(3, 6))),
        lambda: "_".join(word() for _ in range(made.randint(3, 6))),
        lambda: "".join(word().capitalize() for _ in range(made.randint(3, 6))),
        lambda: "_".join(word().upper() for _ in range(made.randint(3, 6))),
        lambda: "/".join(word() for _ in range(made.randint(3, 6))),
        lambda: ".".join(word() for _ in range(made.randint(3, 6))),
        lambda: f"{word()}{number(1)}.{word()}.com",
        lambda: number(made.randint(16, 20)),
        lambda: "-".join(number(4) for _ in range(4)),
        lambda: "-".join("".join(made.choices("0123456789abcdef", k=k)) for k in (8, 4, 4, 4, 12)),
        lambda: f"{number(4)}-{number(2)}-{number(2)}T{number(2)}",
        lambda: f"{word(5)}-{number(1)}.{number(2)}.{number(1)}",
        lambda: made.choice("=-_.") * made.randint(16, 40),
    )
    return [kind() for kind in kinds for _ in range(n)]


def _symbol(c: str) -> str:
    """Classes of characters: letters by case and by use in hexadecimal numbers, digits; others are themselves."""
    if c.isdigit():
        return "d"
    if c.isalpha():
        return ("h" if c in "abcdef" else "l") if c.islower() else ("H" if c in "ABCDEF" else "U")
    return c


_CLASSES = str.maketrans({c: _symbol(c) for c in string.printable})


def symbols(token: str) -> str:
    """One class for each character."""
    return token.translate(_CLASSES)


class Automaton:
    """A probabilistic automaton from a sample, by merging compatible states of its prefix tree."""

    def __init__(self, sample: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.through: list[dict[str, int]] = [{}]
        self.ends, self.all = [0], [0]
        for token in sample:
            at = 0
            self.all[0] += 1
            for s in symbols(token):
                self.through[at][s] = self.through[at].get(s, 0) + 1
                if s not in self.next[at]:
                    self.next[at][s] = len(self.next)
                    self.next.append({})
                    self.through.append({})
                    self.ends.append(0)
                    self.all.append(0)
                at = self.next[at][s]
                self.all[at] += 1
            self.ends[at] += 1
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()

    def _merge_states(self) -> None:
        red, blue = [0], deque(self.next[0].items())
        blue = deque((0, s) for s in sorted(self.next[0]))
        while blue:
            parent, s = blue.popleft()
            state = self.next[parent][s]
            if state in red:
                continue
            for other in red:
                if self._compatible(other, state):
                    self.next[parent][s] = other
                    self._fold(other, state)
                    break
            else:
                red.append(state)
            blue.extend((r, x) for r in red for x in sorted(self.next[r]) if self.next[r][x] not in red and (r, x) not in blue)
        self.states = red

    def _apart(self, f: int, n: int, g: int, m: int) -> bool:
        return bool(n and m) and abs(f / n - g / m) > self._bound * (n**-0.5 + m**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if self._apart(self.ends[a], self.all[a], self.ends[b], self.all[b]):
                return False
            for s in self.through[b].keys() | self.through[a].keys():
                if self._apart(self.through[a].get(s, 0), self.all[a], self.through[b].get(s, 0), self.all[b]):
                    return False
                if s in self.next[a] and s in self.next[b]:
                    stack.append((self.next[a][s], self.next[b][s]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the subtree at ``b`` to the state ``a``."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.ends[a] += self.ends[b]
            self.all[a] += self.all[b]
            for s, n in self.through[b].items():
                self.through[a][s] = self.through[a].get(s, 0) + n
                if s in self.next[a]:
                    stack.append((self.next[a][s], self.next[b][s]))
                else:
                    self.next[a][s] = self.next[b][s]

    def compact(self) -> list[dict[str, tuple[float, int]]]:
        """For each state the log-probability and the next state of each symbol; '' ends the token."""
        place = {s: i for i, s in enumerate(self.states)}
        out = []
        for state in self.states:
            n = self.all[state] + 1.0
            row = {s: (math.log(k / n), place[self.next[state][s]]) for s, k in self.through[state].items()}
            row[""] = (math.log((self.ends[state] + 1e-3) / n), -1)
            out.append(row)
        return out


#: Log-probability of a symbol that a state has never seen, and formats whose scores a task keeps.
UNSEEN, MOST_KEPT = math.log(1e-3), 200_000


def log_likelihood(automaton: list[dict[str, tuple[float, int]]], classes: str) -> float:
    """Log-probability of a sequence of classes; how it ends does not count, since runs may be cut anywhere.

    After a class that a state has never seen the sequence goes on as from the start.
    """
    total, at = 0.0, 0
    for s in classes:
        step = automaton[at].get(s)
        total += step[0] if step else UNSEEN
        step = step or automaton[0].get(s)
        at = step[1] if step else 0
    return total


def candidates(text: str) -> Iterator[tuple[int, list[str]]]:
    """(start, parts) of every run that may hold a credential: what stands between ``=`` signs, with its ends bare of marks.

    ``parts`` has the whole first, then what stands between slashes and dots in it.
    """
    for run in _RUN.finditer(text):
        at = run.start()
        for piece in run[0].split("="):
            bare = piece.strip("+/_.-")
            if len(bare) >= LENGTH:
                yield at + piece.index(bare), [bare, *([x for x in re.split("[/.]", bare) if len(x) >= LENGTH] if "/" in bare or "." in bare else [])]
            at += len(piece) + 1


class Scanner:
    """Base spans and scored candidates of a text."""

    def __init__(self, credential: list, ordinary: list, total: float = TOTAL, each: float = EACH):
        self.credential, self.ordinary, self.total, self.each = credential, ordinary, total, each
        self._kept: dict[str, float] = {}

    @classmethod
    def trained(cls, credentials: list[str], others: list[str], alpha: float = ALPHA, formats: tuple = FORMATS) -> Scanner:
        known = labelled_credentials(formats=formats) + credentials
        return cls(Automaton(known, alpha).compact(), Automaton(ordinary_tokens() + others, alpha).compact())

    def score(self, token: str) -> float:
        """Log-likelihood ratio of the token's format."""
        classes = symbols(token)
        if (found := self._kept.get(classes)) is None:
            if len(self._kept) > MOST_KEPT:
                self._kept.clear()
            found = self._kept[classes] = log_likelihood(self.credential, classes) - log_likelihood(self.ordinary, classes)
        return found

    def takes(self, token: str) -> bool:
        return self.score(token) >= max(self.total, self.each * len(token))

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) in order of start, then kind."""
        found = []
        low = text.lower()
        if any(k in low for k in _KEYWORDS):
            found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        return sorted(found)

    def more(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Candidates whose format is likely, but for what lies in a base span.

        Parts of a candidate that are likelier, by character, than the whole come in its place.
        """
        out = []
        for start, (whole, *parts) in candidates(text):
            found = [whole] if self.takes(whole) else []
            if better := [p for p in parts if self.takes(p) and (not found or self.score(p) / len(p) > self.score(whole) / len(whole))]:
                found = better
            at = 0
            for token in found:
                at = whole.index(token, at)
                a, b = start + at, start + at + len(token)
                at += len(token)
                if not any(s <= a and b <= e for s, _, e in base):
                    out.append((a, 3, b))
        return out


def labels(texts: list[str]) -> tuple[list[str], list[str]]:
    """Credentials (what the base patterns find) and other candidates of some texts."""
    scanner = Scanner([], [])
    credentials, others = [], []
    for text in texts:
        base = scanner.base(text)
        credentials += [m[2] for m in _ASSIGN.finditer(text) if len(m[2]) >= LENGTH]
        credentials += [text[a:b] for a, kind, b in base if kind]
        others += [parts[0] for at, parts in candidates(text) if not any(s < at + len(parts[0]) and at < e for s, _, e in base)]
    return credentials, others


def train(docs: DataFrame, alpha: float = ALPHA) -> Scanner:
    """A scanner with labels from ``docs`` (doc_id, text) and the specimens.

    Labels come from at most ``MOST_DOCUMENTS`` documents with base spans and as many of
    all, those with the least hashes, and are at most ``MOST_LABELLED`` different tokens
    of each class; rows with equal doc_id and text count once.
    """
    rows = docs.where("text is not null").select(F.xxhash64("doc_id", "text").alias("at"), "text")
    least = lambda found: found.select("at").distinct().orderBy("at").limit(MOST_DOCUMENTS)
    # At most 2 * MOST_DOCUMENTS numbers.
    some = cut(least(rows.where(F.col("text").rlike(_ANY_BASE))).union(least(rows)).distinct())
    sample = rows.join(F.broadcast(some), "at").dropDuplicates(["at"]).select("text")

    def work(batch: dict) -> dict:
        pairs = {(kind, token) for kind, tokens in enumerate(labels(batch["text"])) for token in tokens}
        return {"kind": [k for k, _ in pairs], "token": [t for _, t in pairs]}

    found = cut(arrow_map(sample, work, "kind int, token string").distinct())
    by_hash = F.xxhash64("token")
    known, others = ([r.token for r in found.where(F.col("kind") == k).orderBy(by_hash, "token").limit(MOST_LABELLED).collect()] for k in (0, 1))
    return Scanner.trained(known, sorted(set(others) - set(known)), alpha)


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """(doc_id, spans: array of kind, start, end) for every row of ``docs`` (doc_id, text).

    Spans are in code points, the end exclusive, by start, then kind as in ``KINDS``.
    A null text counts as empty and has none; repeated rows are scanned each, null
    doc_ids stay null, other columns take no part, an empty table gives an empty result.
    """
    scanner = scanner or train(docs)

    def work(rows: dict) -> dict:
        out = []
        for text in rows["text"]:
            base = scanner.base(text or "")
            spans = sorted(base + scanner.more(text or "", base))
            out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
        return {"doc_id": rows["doc_id"], "spans": out}

    return arrow_map(docs.select("doc_id", "text"), work, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def report(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """The op6 report: counts of base spans, their digest, and all spans, for every row as ``scan`` has it."""
    item = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, item), ",")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = scan(docs, scanner)
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
