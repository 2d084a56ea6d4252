"""SimHash near-deduplication: exact tiled comparison of 64-bit fingerprints.

Fingerprints come from one Arrow-batched pass over whole texts. Equal fingerprints are one node. Nodes within
``radius`` bits agree on at least one of ``radius + 1`` bit blocks, so each node joins the buckets of its blocks;
a bucket is sorted by population count, cut into tiles, and tiles are compared by numpy exclusive-or and bit counts,
skipping tile pairs whose population counts differ by more than the radius. A bucket beyond ``SPLIT`` nodes is dealt
out as sub-tile pairs to many tasks. Each task reduces its links to a spanning forest before it emits anything.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, documents, row_key, shuffle_width, without, written

SHINGLE = 4
RADIUS = 4
#: Nodes in a tile of a comparison, and nodes from which a bucket is dealt out to several tasks.
TILE, SPLIT = 1024, 16384


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half the XXH64 (seed 42) values of the word shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    start = np.cumsum(size + 1) - size - 1
    k = min(shingle, len(words))
    first, last = start[: len(words) - k + 1].tolist(), (start + size)[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, dtype=np.int64), len(first)
    for lo in range(0, n, 1 << 15):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(first[lo:lo + (1 << 15)], last[lo:lo + (1 << 15)])],
                     dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row_key, fp long) of every row."""
    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fp = np.array([fingerprint(t.as_py(), shingle) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64))],
                                             names=["doc_id", "row_key", "fp"])

    return documents(docs, row_key().alias("row_key")).mapInArrow(run, "doc_id long, row_key long, fp long")


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 blocks of the 64 bits."""
    edges = np.linspace(0, 64, radius + 2).round().astype(int).tolist()
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _forest(fp: np.ndarray, part: np.ndarray, cross: bool, radius: int) -> np.ndarray:
    """Index of each node's root under the links of a group; ``fp`` in order of population count. With ``cross``
    only nodes of different parts are compared (the others meet elsewhere)."""
    root = np.arange(len(fp))
    ones = np.bitwise_count(fp).astype(np.int64)
    cuts = list(range(0, len(fp), TILE))
    for a in cuts:
        for b in cuts[a // TILE:]:
            ea, eb = min(a + TILE, len(fp)), min(b + TILE, len(fp))
            if ones[b] - ones[ea - 1] > radius:   # sorted: every later tile is further away
                break
            near = np.bitwise_count(fp[a:ea, None] ^ fp[None, b:eb]) <= radius
            if cross:
                near &= part[a:ea, None] != part[None, b:eb]
            i, j = np.nonzero(near)
            i, j = root[i + a], root[j + b]
            while (move := i != j).any():
                i, j = i[move], j[move]
                low, high = np.minimum(i, j), np.maximum(i, j)
                to = np.arange(len(fp))
                np.minimum.at(to, high, low)
                while not np.array_equal(to, to[to]):
                    to = to[to]
                root, i, j = to[root], to[i], to[j]
    return root


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints ``nodes`` (fp) at most ``radius`` bits apart."""
    buckets = F.array(*[F.struct(F.lit(k).alias("block"),
                                 F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << n) - 1)).alias("key"))
                        for k, (at, n) in enumerate(_blocks(radius))])
    members = nodes.select("fp", F.explode(buckets).alias("s")).select("s.block", "s.key", "fp")
    big = (members.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT)
           .select("block", "key", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts")))
    big = written(big)
    own = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    dealt = (members.join(big, ["block", "key"], "left").withColumn("part", own)
             .select("block", "key", "fp", "part", other.alias("other"))
             .select("block", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
                     "part", F.bit_count("fp").alias("ones"), "fp"))

    def run(batches):
        held: list[np.ndarray] = []

        def solve(rows: np.ndarray):
            order = np.argsort(rows[:, 5], kind="stable")
            rows = rows[order]
            fp = np.ascontiguousarray(rows[:, 6]).view(np.uint64)
            root = _forest(fp, rows[:, 4], rows[0, 2] != rows[0, 3], radius)
            moved = np.flatnonzero(root != np.arange(len(root)))
            return fp[moved].view(np.int64), fp[root[moved]].view(np.int64)

        def groups(rows: np.ndarray, last: bool):
            cut = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            parts = np.split(rows, cut)
            return (parts, []) if last else (parts[:-1], parts[-1:])

        def emit(parts):
            found = [solve(p) for p in parts if len(p) > 1]
            a = np.concatenate([x[0] for x in found] or [np.empty(0, np.int64)])
            b = np.concatenate([x[1] for x in found] or [np.empty(0, np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            rows = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(7)])
            if len(rows) == 0:
                continue
            if held and (held[0][0, :4] != rows[0, :4]).any():
                yield emit([np.concatenate(held)])
                held = []
            if held and (rows[-1, :4] == rows[0, :4]).all():   # still the same bucket
                held.append(rows)
                continue
            parts, held = groups(np.concatenate([*held, rows]), False)
            yield emit(parts)
        if held:
            yield emit([np.concatenate(held)])

    keys = ["block", "key", "i", "j"]
    n = shuffle_width(nodes.sparkSession)
    return (dealt.repartition(n, *keys).sortWithinPartitions(*keys)
            .mapInArrow(run, "a long, b long").distinct())


def _components(docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    """(doc_id, row_key, fp, root, component_id) of every row; root names the component also where no row has an id."""
    rows = written(fingerprints(docs, shingle))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(nodes.select("fp"), radius))
    named = (nodes.join(roots, nodes["fp"] == roots["node"], "left")
             .select("fp", "low", F.coalesce("root", "fp").alias("root")))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "row_key", "fp", "root", "component_id")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, row_key; links of fingerprints at
    ``radius`` or fewer differing bits followed transitively; component_id is the smallest doc_id reachable.

    Null and empty texts have fingerprint zero and are linked like any other. A null doc_id gets the id of its
    component (null only if no row of the component has an id). Repeated rows stay, with equal results. An empty
    table gives no rows."""
    return _components(docs, shingle, radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "row_key")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component, all columns kept: that of the smallest doc_id (null last; of several
    texts under that id, or without any id, the one of smallest row key). Null and empty texts are one component. Rows
    that repeat the id and text of the document that stays are that document and stay; exact dedup takes them before.
    An empty table stays empty."""
    rows = written(_components(docs, shingle, radius).select("row_key", "doc_id", "root"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key")
    stays = rows.groupBy("root").agg(F.min(order)["row_key"].alias("row_key")).select("row_key")
    return without(docs, rows.select("row_key").join(stays, "row_key", "left_anti"))
