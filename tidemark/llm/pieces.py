"""SentencePiece ids of whole texts through tables of distinct chunks.

Where no piece of a vocabulary has a white-space marker behind another character, no merge crosses from a character to
the marker after it: a text's segmentation is that of its chunks (a run of markers and the characters up to the next
one) put together. So each task keeps a table of the distinct chunks it has met, segments each of them once, by the
library itself, and joins the ids back to all the places of the chunk in its documents, in order.

The table is bounded in bytes and emptied when full (a chunk that comes again is then segmented again: same ids). No
text is shuffled, no table grows with the input, and a lost task repeats only itself.
"""

from __future__ import annotations

import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import documents

MARK = "▁"
#: Characters of chunks and ids that a task's table holds at most, beyond those of the document at hand.
TABLE_CHARS = 48 << 20
_CHUNK = re.compile(" +[^ ]*")
_PROBES = ["", " ", "a", " a", "a  b ", "a\tb\n", "ﬁ　x", "é é", MARK + "x", "A b"]


@functools.lru_cache(maxsize=4)
def processor(model: bytes):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def separable(sp) -> bool:
    """Whether chunks can be segmented one by one: no piece crosses into a marker, and normalising does no more than
    to mark spaces and the beginning."""
    if any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size())):
        return False
    return all(sp.normalize(t) == (MARK + t.replace(" ", MARK) if t else "") for t in _PROBES)


def chunks(text: str, split: bool) -> list[str]:
    """Chunks of a text, each without its first marker, markers as spaces; the whole text if it can't be split."""
    if not text:
        return []
    if not split:
        return [text]
    return [c[1:] for c in _CHUNK.findall(" " + text.replace(MARK, " "))]


def segment_chunks(sp, own: list[str]) -> list[list[int]]:
    """Ids of chunks. A chunk that is one marker alone is empty here, and the library marks no empty text: its ids are
    those that a trailing space adds."""
    ids = sp.encode(own, num_threads=1)
    if "" in own:
        ids[own.index("")] = sp.encode("a ")[len(sp.encode("a")):]
    return ids


class ChunkTable:
    """Distinct chunks with their ids as text, and the decoded form of those that don't decode to themselves."""

    def __init__(self, sp, split: bool):
        self.sp, self.split = sp, split
        self.ids: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.size = 0

    def add(self, new: list[str]) -> None:
        for c, i in zip(new, segment_chunks(self.sp, new)):
            self.ids[c] = " ".join(map(str, i))
            self.size += len(c) + len(self.ids[c])
            surface = self.sp.decode(i)
            if surface != c:
                self.odd[c] = surface

    def __call__(self, text: str) -> tuple[list[str], str]:
        """Ids (as text, chunk by chunk) and decoded form of a text."""
        if self.size > TABLE_CHARS:
            self.ids, self.odd, self.size = {}, {}, 0
        own, ids, odd = chunks(text, self.split), self.ids, self.odd
        try:
            found = [ids[c] for c in own]
        except KeyError:
            self.add([c for c in dict.fromkeys(own) if c not in ids])
            found = [ids[c] for c in own]
        return found, " ".join([odd.get(c, c) for c in own] if odd else own)


def encode_texts(docs: DataFrame, model: bytes) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are not read): doc_id, n_tokens, ids (decimal, joined by
    one space, the end id last), decoded.

    Null texts are empty; an empty text is the end id alone. Repeated rows and null doc_ids each keep their row. A very
    long text is encoded whole, in one task. An empty table gives no rows. If the vocabulary has pieces that cross a
    marker, or normalises, each distinct text is one chunk: same result, slower."""
    sp = processor(model)
    split, end = separable(sp), str(sp.eos_id())
    shared = docs.sparkSession.sparkContext.broadcast(model)          # one vocabulary

    def run(batches):
        table = ChunkTable(processor(shared.value), split)
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                found, decoded = table(t)
                ids = " ".join([*found, end])
                rows.append((ids.count(" ") + 1, ids, decoded))
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids", "decoded"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")
