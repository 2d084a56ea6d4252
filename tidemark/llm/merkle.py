"""Merkle manifest of a data set: a hash tree per source over its documents and one over the sources' roots.

Nodes have 16 children. A tree is cut into aligned subtrees ("blocks") of at most three hash levels, 4,096 leaves; each
block is stored as one byte string in van Emde Boas order: a subtree of ``h`` node levels is its top half (``h // 2``
levels) followed by the bottom subtrees, each laid out the same way. Addresses are arithmetic, so neither building a
block nor finding the siblings of a leaf needs pointers or knows a cache size. The roots of a tier's blocks are the
leaves of the next tier, up to one root per source; the sources' roots are the leaves of one more tree.

Spark deals the blocks out: positions come from a range partitioning and running counts (no source is sorted in one
task), a block is one bounded group however many rows its source has, and each further tier has 1/4096 of the rows.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shuffle_width, written

FANOUT, LEVELS = 16, 3
BLOCK_LEAVES = FANOUT ** LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---- one block: van Emde Boas addresses --------------------------------------------------------------------------

@functools.lru_cache(maxsize=None)
def nodes_in(levels: int) -> int:
    """Nodes of a complete subtree of ``levels`` node levels."""
    return (FANOUT ** levels - 1) // (FANOUT - 1)


def address(levels: int, depth: int, index):
    """Place of node ``index`` (from the left, a number or an array) at ``depth`` (root 0) of a complete subtree."""
    if levels == 1:
        return index * 0
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    below = levels - top
    span = FANOUT ** (depth - top)
    return nodes_in(top) + index // span * nodes_in(below) + address(below, depth - top, index % span)


def hash_levels(n: int) -> int:
    """Hash levels of a block that is the lowest tier of a tree of ``n`` leaves: at most ``LEVELS``."""
    k = 0
    while n > 1 and k < LEVELS:
        n, k = -(-n // FANOUT), k + 1
    return k


def _hash(digests: bytes) -> bytes:
    """SHA-256 of the digests as hex text, one after the other."""
    return hashlib.sha256(digests.hex().encode()).digest()


class Block:
    """An aligned subtree: ``width`` leaves and the node levels above them, in one array of 32-byte digests."""

    def __init__(self, store: np.ndarray, width: int, hashes: int):
        self.store, self.levels = store, hashes + 1
        self.runs: dict[tuple[int, int], bytes] = {}
        self.widths = [0] * self.levels            # nodes per depth
        for depth in range(hashes, -1, -1):
            self.widths[depth], width = width, -(-width // FANOUT)

    @classmethod
    def build(cls, leaves: list[bytes], hashes: int) -> "Block":
        block = cls(np.zeros((0, 32), np.uint8), len(leaves), hashes)
        last = max(int(address(block.levels, d, w - 1)) for d, w in enumerate(block.widths))
        block.store = np.zeros((last + 1, 32), np.uint8)
        block.store[address(block.levels, hashes, np.arange(len(leaves)))] = np.frombuffer(
            b"".join(leaves), np.uint8).reshape(-1, 32)
        for depth in range(hashes - 1, -1, -1):
            at = address(block.levels, depth, np.arange(block.widths[depth]))
            for i, place in enumerate(at):
                block.store[place] = np.frombuffer(_hash(block.run(depth + 1, i)), np.uint8)
        return block

    @classmethod
    def load(cls, layout: bytes, width: int, hashes: int) -> "Block":
        return cls(np.frombuffer(layout, np.uint8).reshape(-1, 32), width, hashes)

    def run(self, depth: int, parent: int) -> bytes:
        """The digests of the children, at ``depth``, of a node of the level above."""
        own = self.runs.get((depth, parent))
        if own is None:
            kids = np.arange(parent * FANOUT, min((parent + 1) * FANOUT, self.widths[depth]))
            own = self.runs[depth, parent] = self.store[address(self.levels, depth, kids)].tobytes()
        return own

    def root(self) -> bytes:
        return self.store[0].tobytes()

    def steps(self, pos: int):
        """From leaf ``pos`` to the block's root: (place within the run, digests of the run) per hash level."""
        for depth in range(self.levels - 1, 0, -1):
            yield pos % FANOUT, self.run(depth, pos // FANOUT)
            pos //= FANOUT


# A path upwards is packed as: place in the run (1 byte), nodes of the run (1 byte), their digests; level by level.

def pack(steps) -> bytes:
    return b"".join(bytes((at, len(run) // 32)) + run for at, run in steps)


def unpack(path: bytes) -> list[tuple[int, bytes]]:
    steps, i = [], 0
    while i < len(path):
        at, n = path[i], path[i + 1]
        steps.append((at, path[i + 2:i + 2 + 32 * n]))
        i += 2 + 32 * n
    return steps


def siblings(step: tuple[int, bytes]) -> bytes:
    at, run = step
    return run[:32 * at] + run[32 * at + 32:]


def fold(digest: bytes, steps) -> bytes:
    """The root that follows from ``digest`` and the siblings on its way up."""
    for at, run in steps:
        digest = _hash(run[:32 * at] + digest + run[32 * at + 32:])
    return digest


# ---- trees of all sources ----------------------------------------------------------------------------------------

def field(c: Column) -> Column:
    """``-`` for null, else the byte count of the value as text, a colon and the value."""
    t = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))), 256))


def source_key(source: Column) -> Column:
    """Null becomes the empty string, anything else is marked; bytewise order with null first."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, tampered) of every row; ``tampered`` is the leaf of the altered row, null where unaltered."""
    d = docs.select("doc_id", "source", "lang", "n_chars", "text")
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    altered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0) & F.col("text").isNotNull()
    return d.select(source_key(F.col("source")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
                    leaf_digest(*own, F.col("text")).alias("leaf"),
                    F.when(altered, leaf_digest(*own, F.translate("text", UPPER, LOWER))).alias("tampered"))


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``at`` (0, 1, ... in ``order`` within each ``tree``) and ``size`` (rows of the tree).

    Rows are range-partitioned by tree and order, numbered inside their partition, and shifted by the rows of the same
    tree in earlier partitions: one small row per partition and tree, summed in a window over the partitions."""
    spark = rows.sparkSession
    keys = ["tree", *order]
    names = rows.columns

    def number(batches):
        last, n = None, 0
        for b in batches:
            trees = b.column(names.index("tree")).to_pylist()
            own = np.empty(len(trees), np.int64)
            for i, t in enumerate(trees):
                n = n + 1 if t == last else 0
                last, own[i] = t, n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own)], names=[*b.schema.names, "own"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    dealt = (rows.repartitionByRange(shuffle_width(spark), *keys).sortWithinPartitions(*keys)
             .mapInArrow(number, f"{schema}, own long").withColumn("part", F.spark_partition_id()))
    dealt = written(dealt)
    runs = dealt.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy("tree")
    before = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = written(runs.select("tree", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"),
                               F.sum("n").over(every).alias("size")))
    return (dealt.join(runs, ["tree", "part"])
            .select(*names, (F.col("own") + F.col("shift")).alias("at"), "size"))


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows with ``at`` get the number of their block and their place in it."""
    return rows.withColumn("block", F.floor(F.col("at") / BLOCK_LEAVES).cast("long")) \
               .withColumn("pos", (F.col("at") % BLOCK_LEAVES).cast("int"))


BLOCKS = "tree string, block long, width int, hashes int, size long, root binary, layout binary"


def build_blocks(rows: DataFrame) -> DataFrame:
    """One row per block from rows (tree, block, pos, size, leaf): its layout and root. Groups are bounded."""
    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        size = t.column("size")[0].as_py()
        b = Block.build(t.column("leaf").to_pylist(), hash_levels(size))
        return pa.table({"tree": t.column("tree").slice(0, 1), "block": t.column("block").slice(0, 1),
                         "width": pa.array([t.num_rows], pa.int32()), "hashes": pa.array([b.levels - 1], pa.int32()),
                         "size": t.column("size").slice(0, 1), "root": pa.array([b.root()], pa.binary()),
                         "layout": pa.array([b.store.tobytes()], pa.binary())})

    return rows.select("tree", "block", "pos", "size", "leaf").groupBy("tree", "block").applyInArrow(build, BLOCKS)


@dataclass
class Tree:
    """Written tables of a forest: the numbered leaves and the blocks of each tier (lowest first)."""
    leaves: DataFrame
    tiers: list[DataFrame]

    def roots(self) -> DataFrame:
        """(tree, root): of the tier at which a tree has one block."""
        out = None
        for t in self.tiers:
            own = t.where(F.col("size") <= BLOCK_LEAVES).select("tree", "root")
            out = own if out is None else out.unionByName(own)
        return out


def build_tree(rows: DataFrame, order: list[str]) -> Tree:
    """Hash trees, one per ``tree``, over rows (tree, leaf, ...) in ``order``."""
    numbered = written(_grouped(positions(rows, order)))
    tiers = [written(build_blocks(numbered))]
    while True:
        above = (tiers[-1].where(F.col("size") > BLOCK_LEAVES)
                 .select("tree", F.col("block").alias("at"), F.col("root").alias("leaf"),
                         F.ceil(F.col("size") / BLOCK_LEAVES).cast("long").alias("size")))
        if above.isEmpty():
            return Tree(numbered, tiers)
        tiers.append(written(build_blocks(_grouped(above))))


def _climb(rows: DataFrame, blocks: DataFrame, emit, schema: str) -> DataFrame:
    """``emit(leaf rows of a block, block, rest of the path above it, block row)`` for every block. Rows of equal
    (tree, block) meet their block: a bounded group on one side, one row on the other."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = right.to_pylist()[0]
        return emit(left, Block.load(row["layout"], row["width"], row["hashes"]), row)

    return rows.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(run, schema)


def paths_down(tree: Tree, tops: DataFrame) -> DataFrame:
    """The lowest tier's blocks with ``above``, the packed path from the block's root on.

    ``tops`` (tree, above): the path above a tree's root. Tiers are walked from the top: the blocks of a tier hand each
    block below it the steps inside themselves and their own path."""
    paths = None
    for k in range(len(tree.tiers) - 1, -1, -1):
        tier = tree.tiers[k]
        top = tier.where(F.col("size") <= BLOCK_LEAVES).join(tops, "tree")
        if paths is not None:
            low = tier.where(F.col("size") > BLOCK_LEAVES).join(paths, ["tree", "block"])
            top = top.unionByName(low.select(*top.columns))
        if k == 0:
            return written(top)

        def steps(left: pa.Table, block: Block, row: dict) -> pa.Table:
            own = [pack(block.steps(p)) + row["above"] for p in left.column("pos").to_pylist()]
            return pa.table({"tree": left.column("tree"), "block": left.column("below"), "above": pa.array(own, pa.binary())})

        below = _grouped(tree.tiers[k - 1].where(F.col("size") > BLOCK_LEAVES)
                         .select("tree", F.col("block").alias("at"), F.col("block").alias("below")))
        paths = _climb(below, top, steps, "tree string, block long, above binary")


@dataclass
class Manifest:
    """The manifest's tables: trees of the sources and the tree over their roots."""
    sources: Tree
    top: Tree

    def root(self) -> bytes | None:
        r = self.top.roots().first()
        return None if r is None else bytes(r["root"])


def build_manifest(docs: DataFrame) -> Manifest:
    """Trees over ``docs`` (doc_id, source, lang, n_chars, text; other columns are not read).

    A source's leaves ascend by doc_id (null first, repeated ids by their digest, so that row order never matters).
    Null in any column is written ``-``; empty and very long texts are values like any other; repeated rows are leaves
    of their own. An empty table has no trees and no root."""
    sources = build_tree(written(leaves(docs)), ["doc_id", "leaf"])
    subroots = sources.roots().select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("leaf"))
    return Manifest(sources, build_tree(subroots, ["name"]))


PROOFS = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "verified boolean")


def prove(manifest: Manifest) -> DataFrame:
    """One row per leaf: its digest, its source's root, the root, the SHA-256 of all siblings up to the root, the root
    folded from the (altered, where it has been) leaf and those siblings, and whether that is the root."""
    root = manifest.root()
    if root is None:
        return manifest.sources.leaves.sparkSession.createDataFrame([], PROOFS)
    tops = manifest.top.leaves.select(F.lit("").alias("tree")).distinct().withColumn("above", F.lit(b""))

    def to_root(left: pa.Table, block: Block, row: dict) -> pa.Table:
        return pa.table({"tree": left.column("name"), "subroot": left.column("leaf"), "above": pa.array(
            [pack(block.steps(p)) + row["above"] for p in left.column("pos").to_pylist()], pa.binary())})

    top = _climb(manifest.top.leaves, paths_down(manifest.top, tops), to_root, "tree string, subroot binary, above binary")
    top = written(top)
    blocks = paths_down(manifest.sources, top.select("tree", "above")).join(top.select("tree", "subroot"), "tree")
    wanted = root.hex()

    def proofs(left: pa.Table, block: Block, row: dict) -> pa.Table:
        above = unpack(row["above"])
        rest = b"".join(map(siblings, above)).hex().encode()
        out = {k: [] for k in ("leaf", "proof_sha256", "folded_root")}
        for pos, leaf, other in zip(left.column("pos").to_pylist(), left.column("leaf").to_pylist(),
                                    left.column("tampered").to_pylist()):
            own = list(block.steps(pos))
            out["leaf"].append(leaf.hex())
            out["proof_sha256"].append(hashlib.sha256(b"".join(map(siblings, own)).hex().encode() + rest).hexdigest())
            out["folded_root"].append(fold(fold(leaf if other is None else other, own), above).hex())
        n = left.num_rows
        return pa.table({"doc_id": left.column("doc_id"), "leaf": pa.array(out["leaf"], pa.string()),
                         "subroot": pa.array([row["subroot"].hex()] * n, pa.string()),
                         "root": pa.array([wanted] * n, pa.string()),
                         "proof_sha256": pa.array(out["proof_sha256"], pa.string()),
                         "folded_root": pa.array(out["folded_root"], pa.string()),
                         "verified": pa.array([f == wanted for f in out["folded_root"]], pa.bool_())})

    return _climb(manifest.sources.leaves, blocks, proofs, PROOFS)


def manifest_proofs(docs: DataFrame) -> DataFrame:
    """``prove(build_manifest(docs))``: one row per row of ``docs``, none for an empty table."""
    return prove(build_manifest(docs))
