"""Token counts of byte-level BPE without encoding documents.

A text is cut into pre-tokens.  The number of pieces of a pre-token does not depend
on what is around it, so pieces are counted once for each distinct pre-token of a
task, in a table that is then joined to the pre-token frequencies of each document
and summed.  No ids of a document are made.

The table is each task's own.  One table for the whole corpus would need a shuffle
row for every (document, distinct pre-token), several times the size of the texts,
to save counting a few million short strings again; here nothing is shuffled, and
a task that is lost is just run again.

Documents whose characters are all Latin letters, digits and common punctuation are
cut with a plain pattern that has the tokenizer's classes written out; any other
document is cut by the tokenizer library's own pre-tokenizer.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame

from callweave.llm.common import arrow_map

#: Entries of a task's table at most; it then starts afresh.
MOST_ENTRIES = 500_000
LIMIT = 1024
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

# The tokenizer's classes of characters up to U+02C1 and of common punctuation.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ˁ"
_DIGITS = "0-9²³¹¼-¾"
_BLANK = "\\t-\\r \\x85\\xa0"
_KNOWN = re.compile("[\\x00-\\u02c1\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20bf]*")
_CUT = re.compile(
    f"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{_BLANK}{_LETTERS}{_DIGITS}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)


class _Pieces(dict):
    """Pieces of each pre-token that was asked for."""

    def __init__(self, encode: Callable[[bytes], list[int]]):
        super().__init__()
        self._encode = encode

    def __missing__(self, pretoken: str) -> int:
        n = self[pretoken] = len(self._encode(pretoken.encode()))
        return n


def _byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class PretokenCounter:
    """Counts tokens as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` has them.

    ``path``: a byte-level BPE in the ``tokenizers`` JSON format, whose merges are in
    order of their ids.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        plain = pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not spec["normalizer"]
        if not plain or model["type"] != "BPE" or model.get("dropout"):
            raise ValueError(f"not a plain byte-level BPE: {path}")
        byte, added = _byte_letters(), [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(byte[c] for c in k): v for k, v in model["vocab"].items() if k not in added}
        self._core = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self._pre = Tokenizer.from_file(path).pre_tokenizer
        self._added = re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.pieces = _Pieces(self._core.encode_single_piece)

    def pretokens(self, text: str) -> list[str]:
        if _KNOWN.fullmatch(text):
            return _CUT.findall(text)
        return [text[a:b] for _, (a, b) in self._pre.pre_tokenize_str(text)]

    def count(self, text: str) -> int:
        if len(self.pieces) > MOST_ENTRIES:
            self.pieces.clear()
        parts = self._added.split(text) if self._added else [text]
        frequency = Counter(self.pretokens(parts[0]))
        for part in parts[1:]:
            frequency.update(self.pretokens(part))
        pieces = self.pieces
        return sum(pieces[k] * n for k, n in frequency.items()) + len(parts) - 1


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` (doc_id, text).

    A null text counts as empty: 0 bytes, 0 tokens.  Repeated rows are counted each;
    an empty table gives an empty result.  ``tokenizer`` must be readable on executors.
    """

    def make():
        counter = PretokenCounter(tokenizer)

        def work(columns: dict) -> dict:
            texts = [t or "" for t in columns["text"]]
            n = [counter.count(t) for t in texts]
            return {"doc_id": columns["doc_id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return work

    return arrow_map(docs.select("doc_id", "text"), None, SCHEMA, make)
