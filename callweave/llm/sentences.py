"""SentencePiece encoding and decoding through a table of distinct marked words.

In a model none of whose pieces goes on past a blank marker, merges never cross from
one marked word to the next, so a text is cut before every run of markers and each
distinct marked word is segmented once a task; documents get their ids by joining the
words of their positions to that table.  Models with pieces across markers, or with
another normalisation than escaping blanks, are refused.

Table and documents meet inside a task: nothing is shuffled, and order within a
document is kept by position.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from callweave.llm.common import arrow_map, packed

MARK = "▁"
#: Entries of a task's table at most; it then starts afresh.
MOST_ENTRIES = 300_000
_CHUNK = re.compile(" *[^ ]+| +")
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class ChunkTable:
    """``encode`` and ``decode`` of a sentencepiece BPE model by distinct chunks.

    A chunk is a run of blank markers and what follows up to the next one, kept
    without its first marker; that marker is the library's own dummy prefix when
    the chunk is segmented alone.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("pieces of this model cross blank markers")
        if self.model.encode("  ﬁ  a") != [*self.model.encode(" "), *self.model.encode("ﬁ"), *self.model.encode(" a")]:
            raise ValueError("this model normalises its input")
        self._mark = pieces.index(MARK)
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[str, str] = {}  # of each chunk, in decimals joined by commas
        self.size: dict[str, int] = {}
        self.odd: dict[str, str] = {}  # chunks that are decoded to something else

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(MARK, " ")
        if "  " not in text and not text.endswith(" ") and not text.startswith(" "):
            return text.split(" ")
        return [c[1:] for c in _CHUNK.findall(" " + text)]

    def learn(self, chunks: set[str]) -> None:
        """Segment the chunks that the table lacks."""
        if len(self.ids) > MOST_ENTRIES:
            self._clear()
        new = [c for c in chunks if c not in self.ids]
        for chunk, ids in zip(new, self.model.encode(new, num_threads=1), strict=True):
            ids = ids or [self._mark]
            self.ids[chunk] = ",".join(map(str, ids))
            self.size[chunk] = len(ids)
            if (back := self.model.decode(ids)) != chunk:
                self.odd[chunk] = back

    def encode_batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids joined by commas, decoded text) of each text."""
        cut = [self.chunks(t) for t in texts]
        self.learn({c for chunks in cut for c in chunks})
        ids, size, odd = self.ids.__getitem__, self.size.__getitem__, self.odd
        return [
            (sum(map(size, chunks)), ",".join(map(ids, chunks)), " ".join([odd.get(c, c) for c in chunks] if odd else chunks)) for chunks in cut
        ]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(row, ids, decoded): every row of ``docs`` as a struct, its ids (array of int) and the text they are decoded to.

    A null text counts as empty and has no ids.  Columns of any name may stand beside text.
    """
    rows = docs.select(packed(docs).alias("row"))

    def make():
        chunks = ChunkTable(model)

        def work(batch: dict) -> dict:
            found = chunks.encode_batch([r["text"] or "" for r in batch["row"]])
            return {
                "row": batch["row"],
                "ids": [[int(x) for x in ids.split(",")] if ids else [] for _, ids, _ in found],
                "decoded": [d for _, _, d in found],
            }

        return work

    return arrow_map(rows, None, f"row {dict(rows.dtypes)['row']}, ids array<int>, decoded string", make, step=256)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs`` (doc_id, text).

    A null text counts as empty.  Repeated rows are encoded each; an empty table gives
    an empty result.  ``model`` must be readable on executors.
    """
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def make():
        chunks = ChunkTable(model)

        def work(rows: dict) -> dict:
            found = chunks.encode_batch([t or "" for t in rows["text"]])
            return {
                "doc_id": rows["doc_id"],
                "n_tokens": [n for n, _, _ in found],
                "ids_sha256": [sha(ids) for _, ids, _ in found],
                "decoded_sha256": [sha(text) for _, _, text in found],
            }

        return work

    return arrow_map(docs.select("doc_id", "text"), None, DIGESTS, make, step=256)
