"""Substring deduplication by fixed-block anchors.

A repeat of ``WINDOW`` words always covers a whole block of ``BLOCK = WINDOW // 2`` words of the reference, wherever
it starts. So the non-overlapping blocks of every document are the index, every rolling window of ``BLOCK`` words is
a probe, and a hit is a place where a probe meets a block of another document. Hits are then extended: windows of
``WINDOW`` words over a hit, on both sides, are matched exactly among themselves, and the windows found also in a
document with a smaller id join up to the maximal exact repeats that are removed.

Blocks, probes and windows meet by hash class (one class per shuffle partition). They travel as packed columns: one
row per class and batch of documents, never one row per word. A task keeps the distinct block (or window) hashes of its
class with one smallest and one largest id each; probes stream past them, so a passage that a third of all documents
share costs one entry. Windows of a class, needed twice, wait in a spooled file of the task.
"""

from __future__ import annotations

import io
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tidemark.llm.common import chunks, documents, mix, partition_keys, shuffle_width, window_hashes, word_hashes

WINDOW = 50
#: Windows a task may hold in memory before they wait on its disk, in bytes.
SPOOL = 64 << 20

_PACKED = "class long, kind int, ids binary, counts binary, pos binary, hash binary"
_ROUTED = "class long, ids binary, counts binary, pos binary"


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=dtype)


def _places(text: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Entries in order of (text, position) as document ids, entries per document and steps between positions."""
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    step = np.diff(pos, prepend=0)
    step[first] = pos[first]
    return (_pack(np.diff(ids[first], prepend=0)), _pack(np.diff(np.r_[first, len(ids)]).astype(np.uint32)),
            _pack(step.astype(np.uint32)))


def _rows(keys, kind, h, ids, text, pos, hash_type, shift):
    """One packed row per hash class; entries in order of (document, position)."""
    cls = (h % np.uint64(len(keys))).astype(np.int64)
    order = np.argsort(cls, kind="stable")
    cls, text, pos, h = cls[order], text[order], pos[order], (h[order] >> np.uint64(shift)).astype(hash_type)
    cut = np.flatnonzero(np.diff(cls)) + 1
    for a, b in zip([0, *cut], [*cut, len(cls)]):
        if a == b:
            continue
        yield int(keys[cls[a]]), kind, *_places(text[a:b], ids[text[a:b]], pos[a:b]), h[a:b].tobytes()


def _entries(ids: bytes, counts: bytes, pos: bytes):
    """(document id, position) of every entry of a packed row."""
    n = _unpack(counts, np.uint32).astype(np.int64)
    ids = np.repeat(np.cumsum(_unpack(ids, np.int64)), n)
    step = _unpack(pos, np.uint32).astype(np.int64)
    total = np.cumsum(step)
    first = np.cumsum(n) - n
    return ids, total - np.repeat(total[first] - step[first], n)


def _batch(rows, schema: str):
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(),
             "array<int>": pa.list_(pa.int32())}
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(cols, schema.split(", "))],
                                      names=names)


class _Found:
    """Places found, sent on in packed rows by hash class of their document."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.ids, self.pos, self.held = keys, [], [], 0

    def add(self, ids: np.ndarray, pos: np.ndarray):
        self.ids.append(ids)
        self.pos.append(pos)
        self.held += len(ids)
        if self.held > 1 << 20:
            yield self.flush()

    def flush(self):
        ids = np.concatenate(self.ids or [np.empty(0, np.int64)])
        pos = np.concatenate(self.pos or [np.empty(0, np.int64)])
        self.ids, self.pos, self.held = [], [], 0
        cls = (mix(ids.view(np.uint64)) % np.uint64(len(self.keys))).astype(np.int64)
        order = np.lexsort((pos, ids, cls))
        cls, ids, pos = cls[order], ids[order], pos[order]
        cut = np.flatnonzero(np.diff(cls)) + 1
        rows = [(int(self.keys[cls[a]]), *_places(ids[a:b], ids[a:b], pos[a:b]))
                for a, b in zip([0, *cut], [*cut, len(cls)]) if a < b]
        return _batch(rows, _ROUTED)


def _gathered(routed: DataFrame, keys: np.ndarray) -> DataFrame:
    """(doc_id, pos): all places of a document in one row, at most two per word of it."""
    def gather(batches):
        ids, pos = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for b in batches:
            for k in range(b.num_rows):
                i, p = _entries(*(b.column(c)[k].as_py() for c in (1, 2, 3)))
                ids.append(i)
                pos.append(p)
        ids, pos = np.concatenate(ids), np.concatenate(pos)
        order = np.lexsort((pos, ids))
        ids, pos = ids[order], pos[order]
        cut = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.empty(0, np.int64)
        for lo in range(0, len(cut), 4096):
            own = np.r_[cut[lo:lo + 4096], cut[lo + 4096] if lo + 4096 < len(cut) else len(ids)]
            places = pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)),
                                              pa.array(pos[own[0]:own[-1]].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[own[:-1]]), places], names=["doc_id", "pos"])

    return routed.repartition(len(keys), "class").mapInArrow(gather, "doc_id long, pos array<int>")


def _packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text compressed): the text travels twice, compressed."""
    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([pack.compress(t.as_py()) for t in b.column(1).cast(pa.binary())], pa.binary())],
                names=["doc_id", "packed"])

    return docs.mapInArrow(run, "doc_id long, packed binary")


def _anchors(docs: DataFrame, window: int, keys: np.ndarray) -> DataFrame:
    """(doc_id, pos): places of block-sized windows that occur in two documents, once as an indexed block."""
    block = window // 2

    def emit(batches):
        for b in batches:
            texts = [t.as_py() for t in b.column(1).cast(pa.binary())]
            for ids, own in chunks(b.column(0).to_pylist(), texts, 1 << 23):
                ids = np.array(ids, dtype=np.int64)
                words, per = word_hashes(own)
                h, text, pos = window_hashes(words, per, block)
                fixed = pos % block == 0
                hb, tb, pb = h[fixed], text[fixed], pos[fixed]
                rows = [r for kind in (0, 2) for r in _rows(keys, kind, hb, ids, tb, pb, np.uint32, 32)]
                rows += _rows(keys, 1, h, ids, text, pos, np.uint32, 32)
                for lo in range(0, len(rows), 64):
                    yield _batch(rows[lo:lo + 64], _PACKED)

    def meet(batches):
        """Sorted by class and kind: blocks (index), probes, blocks again (for the reference's side)."""
        now, index, low, high = None, None, None, None
        found = _Found(keys)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def build():
            h = np.concatenate([x[0] for x in waiting])
            ids = np.concatenate([x[1] for x in waiting])
            waiting.clear()
            own, at = np.unique(h, return_inverse=True)
            small = np.full(len(own), np.iinfo(np.int64).max)
            np.minimum.at(small, at, ids)
            return own, small

        held = 0
        for b in batches:
            for k in range(b.num_rows):
                cls, kind, ids, counts, pos, h = (b.column(c)[k].as_py() for c in range(6))
                if cls != now:
                    now, index, low, high, held = cls, None, None, None, 0
                    waiting.clear()
                ids, pos = _entries(ids, counts, pos)
                h = np.frombuffer(h, dtype=np.uint32)
                if kind == 0:
                    waiting.append((h, ids))
                    held += len(h)
                    if held > 1 << 22:       # repeats fold into one entry before more arrive
                        waiting[:] = [build()]
                        held = 0
                    continue
                if index is None:
                    if not waiting:
                        continue
                    index, low = build()
                    high = np.full(len(index), np.iinfo(np.int64).min)
                at = np.searchsorted(index, h)
                at[at == len(index)] = 0
                hit = index[at] == h
                at, ids, pos = at[hit], ids[hit], pos[hit]
                if kind == 1:
                    np.maximum.at(high, at, ids)
                    later = low[at] < ids
                else:
                    later = high[at] > ids
                yield from found.add(ids[later], pos[later])
        yield found.flush()

    n = len(keys)
    return _gathered(docs.mapInArrow(emit, _PACKED).repartition(n, "class").sortWithinPartitions("class", "kind")
                     .mapInArrow(meet, _ROUTED), keys)


def _copies(hit_docs: DataFrame, window: int, keys: np.ndarray) -> DataFrame:
    """(doc_id, pos): windows over an anchor that also start in a document with a smaller id."""
    block = window // 2

    def emit(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            rows_in = ((b.column(0)[k].as_py(), unpack.decompress(b.column(1)[k].as_py()), k)
                       for k in range(b.num_rows))
            group: list = []
            size = 0

            def flush(group):
                ids = np.array([g[0] for g in group], dtype=np.int64)
                words, per = word_hashes([g[1] for g in group])
                h, text, pos = window_hashes(words, per, window)
                start = np.cumsum(per) - per
                mark = np.zeros(len(words) + 1, dtype=np.int64)
                for i, g in enumerate(group):
                    places = b.column(2)[g[2]].values.to_numpy(zero_copy_only=False).astype(np.int64)
                    mark[start[i] + places[places < per[i]] + 1] = 1
                total = np.cumsum(mark)
                at = start[text] + pos
                over = total[at + window - block + 1] > total[at]
                rows = list(_rows(keys, 1, h[over], ids, text[over], pos[over], np.uint64, 0))
                for lo in range(0, len(rows), 64):
                    yield _batch(rows[lo:lo + 64], _PACKED)

            for row in rows_in:
                group.append(row)
                size += len(row[1])
                if size > 1 << 22:
                    yield from flush(group)
                    group, size = [], 0
            if group:
                yield from flush(group)

    def meet(batches):
        now, spool, own, low = None, None, [], []
        found, held = _Found(keys), 0

        def fold():
            h, ids = np.concatenate(own), np.concatenate(low)
            index, at = np.unique(h, return_inverse=True)
            small = np.full(len(index), np.iinfo(np.int64).max)
            np.minimum.at(small, at, ids)
            own[:], low[:] = [index], [small]

        def finish():
            fold()
            spool.seek(0)
            while True:
                head = spool.read(8)
                if not head:
                    break
                with np.load(io.BytesIO(spool.read(int.from_bytes(head, "little")))) as f:
                    h, ids, pos = f["h"], f["ids"], f["pos"]
                later = low[0][np.searchsorted(own[0], h)] < ids
                yield from found.add(ids[later], pos[later])
            spool.close()

        for b in batches:
            for k in range(b.num_rows):
                cls, _, ids, counts, pos, h = (b.column(c)[k].as_py() for c in range(6))
                if cls != now:
                    if now is not None:
                        yield from finish()
                    now, spool, held = cls, tempfile.SpooledTemporaryFile(max_size=SPOOL), 0
                    own.clear()
                    low.clear()
                ids, pos = _entries(ids, counts, pos)
                h = np.frombuffer(h, dtype=np.uint64)
                out = io.BytesIO()
                np.savez(out, h=h, ids=ids, pos=pos.astype(np.int32))
                spool.write(len(out.getvalue()).to_bytes(8, "little"))
                spool.write(out.getvalue())
                own.append(h)
                low.append(ids)
                held += len(h)
                if held > 1 << 22:
                    fold()
                    held = 0
        if now is not None:
            yield from finish()
        yield found.flush()

    n = len(keys)
    return _gathered(hit_docs.mapInArrow(emit, _PACKED).repartition(n, "class").sortWithinPartitions("class")
                     .mapInArrow(meet, _ROUTED), keys)


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """((doc_id, pos) of the windows that a smaller document also has, (doc_id, packed text) of every row)."""
    spark = docs.sparkSession
    keys = partition_keys(spark, shuffle_width(spark))
    d = documents(docs)
    packed = _packed_texts(d)
    hits = _anchors(d.where("doc_id is not null"), window, keys)
    return _copies(packed.join(hits, "doc_id"), window, keys), packed


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text (kept words joined by one space), removed
    (array of [first word, past last word] spans).

    A word ``[^\\x20\\x09-\\x0D]+`` goes if a window of ``window`` words that covers it also starts, word for word, in
    a document with a smaller doc_id; windows are judged on the input. Null texts have no words. A row whose doc_id
    is null is kept whole and is no reference. Rows that repeat a doc_id are one document: they don't remove each
    other, and a place found in one counts for all of them. An empty table gives no rows."""
    places, packed = repeated_spans(docs, window)
    joined = packed.join(places, "doc_id", "left")

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for k in range(b.num_rows):
                words = unpack.decompress(b.column(1)[k].as_py()).split()
                pos = b.column(2)[k].values if b.column(2)[k].is_valid else None
                spans = []
                if pos is not None:
                    pos = np.unique(pos.to_numpy(zero_copy_only=False).astype(np.int64))
                    pos = pos[pos + window <= len(words)]
                    if len(pos):
                        gap = np.flatnonzero(np.diff(pos) > window)
                        spans = list(zip(pos[np.r_[0, gap + 1]].tolist(), (pos[np.r_[gap, len(pos) - 1]] + window).tolist()))
                kept, at = [], 0
                for a, z in spans:
                    kept += words[at:a]
                    at = z
                kept += words[at:]
                out.append((b.column(0)[k].as_py(), len(words), len(words) - len(kept), b" ".join(kept).decode(),
                            [list(s) for s in spans]))
            ids, n, gone, text, spans = zip(*out) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.string()),
                 pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                names=["doc_id", "n_words", "n_removed", "kept_text", "removed"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string, "
                                  "removed array<array<long>>")
