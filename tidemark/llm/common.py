"""Helpers shared by the operators: input projection, tables written to the shared folder, stable partition keys,
connected components, and byte-level tokenising for the Arrow-batched operators."""

from __future__ import annotations

import functools
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_dir


def documents(docs: DataFrame, *extra: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) only, so columns that clash with an operator's own never reach it."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def row_key() -> Column:
    """Names a row by id and text, so that rows without an id, or that share one, are told apart."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``row_key()`` is in ``gone`` (row_key); all columns kept."""
    gone = gone.select(F.col("row_key").alias("_gone")).distinct()
    return docs.join(gone, row_key() == gone["_gone"], "left_anti")


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet under ``spark.checkpoint.dir`` and read back: cuts the lineage at a place every
    executor sees, and gives the optimizer the real size of what it joins next."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tidemark-llm/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def partition_keys(spark: SparkSession, n: int) -> np.ndarray:
    """``n`` integers that ``repartition(n, key)`` deals to ``n`` different partitions (one each)."""
    keys, span = np.full(n, -1, dtype=np.int64), 16
    while (keys < 0).any():
        span *= 4
        rows = (spark.range(n * span).select(F.pmod(F.hash("id"), F.lit(n)).alias("part"), "id")
                .groupBy("part").agg(F.min("id").alias("id")).collect())
        for r in rows:
            keys[r["part"]] = r["id"]
    return keys


def summed(rows: DataFrame, cells, width: int, dtype=np.float64) -> np.ndarray:
    """Sum over all Arrow batches of ``rows`` of ``cells(batch)``, a numeric vector of ``width``.

    Each task sends one packed vector; vectors are added in a tree of square-root fan-in, so at most 64 of them reach
    the driver at any number of tasks. No rows: zeros."""
    def vector(total: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    def own(batches):
        total = np.zeros(width, dtype)
        for b in batches:
            if b.num_rows:
                total += cells(b)
        yield vector(total)

    def merge(batches):
        total = np.zeros(width, dtype)
        for b in batches:
            for v in b.column(0).to_pylist():
                total += np.frombuffer(v, dtype)
        yield vector(total)

    n = rows.rdd.getNumPartitions()
    parts = rows.mapInArrow(own, "v binary")
    while n > 64:
        n = math.isqrt(n)
        parts = parts.repartition(n).mapInArrow(merge, "v binary")
    out = np.zeros(width, dtype)
    for r in parts.collect():
        out += np.frombuffer(r["v"], dtype)
    return out


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b: long): one row (node, root) per node that has an edge,
    root the smallest node of its component.

    Alternating large-star / small-star contraction: only minima per node are aggregated (partial aggregation keeps
    a hub to one row per task); each round is written to the shared folder, so a lost executor repeats one round."""
    spark = edges.sparkSession
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct("u", F.col("m").alias("v")))).alias("s"))
                 .select("s.u", "s.v").where("u <> v").distinct())
        e = written(small)
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


# ---- byte-level words -------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MUL = np.uint64(0x9E3779B97F4A7C15)                      # odd, hence invertible modulo 2^64
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@functools.lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _MUL), ("down", _INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising bit mixer (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-independent polynomial hash of values[start:end] for every span, modulo 2^64."""
    up, down = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts in order, and the words per text."""
    parts = [_word_hashes(own) for _, own in chunks(range(len(texts)), texts, 1 << 19)]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    inside = np.empty(len(buf) + 1, dtype=np.int8)
    inside[0] = 0
    inside[1:] = ~_SPACE[buf]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    h = mix(_spans(_byte_values()[buf], starts, ends) + (ends - starts).astype(np.uint64))
    return h, np.diff(np.searchsorted(starts, at))


def window_hashes(words: np.ndarray, per_text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words inside one text: (hash, text index, first word within the text)."""
    n = np.maximum(per_text - size + 1, 0)
    first = np.cumsum(per_text) - per_text
    text = np.repeat(np.arange(len(per_text)), n)
    pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = first[text] + pos
    return mix(_spans(words, at, at + size)), text, pos


def chunks(ids, texts, limit: int = 1 << 21):
    """Lists of (id, text bytes) of about ``limit`` bytes; a longer text is a chunk of its own."""
    own_ids, own, size = [], [], 0
    for i, t in zip(ids, texts):
        if own and size + len(t) > limit:
            yield own_ids, own
            own_ids, own, size = [], [], 0
        own_ids.append(i)
        own.append(t)
        size += len(t)
    if own:
        yield own_ids, own
