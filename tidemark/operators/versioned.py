"""Keyed tables that grow by generations: insert-if-absent and replacement without reading the whole table.

Layout below the table's path::

    gen=<version>-<tag>/bucket=<b>/*.parquet   rows of one commit, dealt by a hash of the key, sorted by it
    _stats/gen=...                             per bucket: rows, Bloom segments, smallest and largest key columns
    _bloom/gen=...                             per bucket and segment: a bitmap of 32,768 bits
    _ledger/<version>.json                     the table's state: live generations, last epoch applied per source

A batch meets only what can hold its keys: per bucket the key ranges are compared, then the Bloom segments, and only
(generation, bucket) folders that some key may be in are opened, as partition filters of the scan. Statistics and filters
are DataFrame aggregates over the rows just written.

A commit is one exclusive rename of a small file. Until then nobody reads the new folders; a writer that loses the race
computes its batch again on the newer state; an epoch that the ledger knows is a no-op. So replayed, retried and
concurrent batches leave the table as if each had run once, one after the other. (The file system must refuse a rename
onto an existing file: HDFS and local ones do.)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut_lineage

BUCKETS = 32
#: Bits of a Bloom segment (the size of Spark's bitmap aggregate), bits per key, and bits set per key.
SEGMENT_BITS, BITS_PER_KEY, PROBES = 32_768, 12, 4


class Conflict(Exception):
    """Another writer has committed this version."""


@dataclass
class State:
    version: int = 0
    live: list[str] = field(default_factory=list)
    applied: dict[str, int] = field(default_factory=dict)
    schema: str | None = None


class Ledger:
    """The numbered states of a table; committing one that exists already raises ``Conflict``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def state(self) -> State:
        folder = self._path("_ledger")
        fs = folder.getFileSystem(self.conf)
        if not fs.exists(folder):
            return State()
        names = sorted(n for s in fs.listStatus(folder) if (n := s.getPath().getName()).endswith(".json"))
        if not names:
            return State()
        stream = fs.open(self._path(f"_ledger/{names[-1]}"))
        try:
            return State(**json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def commit(self, state: State) -> None:
        target = self._path(f"_ledger/{state.version:08d}.json")
        part = self._path(f"_ledger/.{uuid.uuid4().hex}.part")
        fs = target.getFileSystem(self.conf)
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(vars(state)).encode()))
        out.close()
        hfs = self.jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(getattr(hfs, "Options$Rename"), 0)
        try:
            hfs.FileContext.getFileContext(target.getFileSystem(self.conf).makeQualified(target).toUri(), self.conf) \
                .rename(fs.makeQualified(part), fs.makeQualified(target), none)
        except Exception as e:
            if fs.exists(target):
                fs.delete(part, False)
                raise Conflict(str(target.toString())) from e
            raise


class VersionedTable:
    """A table keyed by ``key``; ``buckets`` must be the same for every writer of a table."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), list(key), buckets
        self.ledger = Ledger(spark, path)

    # ---- reading ------------------------------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def read(self, state: State | None = None, parts: dict[str, list[int]] | None = None) -> DataFrame | None:
        """Rows of the live generations with ``gen`` and ``bucket``; with ``parts`` only of those buckets of a generation
        (a partition filter: other folders are not opened). None for a table that was never written."""
        state = state or self.ledger.state()
        if state.schema is None:
            return None
        schema = T.StructType.fromJson(json.loads(state.schema)).add("gen", T.StringType()).add("bucket", T.IntegerType())
        gens = [g for g in state.live if parts is None or g in parts]
        if not gens:
            return self.spark.createDataFrame([], schema)
        rows = (self.spark.read.schema(schema).option("basePath", self.path)
                .parquet(*[f"{self.path}/gen={g}" for g in gens]))
        if parts is not None:
            wanted = F.lit(False)
            for g in gens:
                wanted = wanted | ((F.col("gen") == g) & F.col("bucket").isin(parts[g]))
            rows = rows.where(wanted)
        return rows

    def _side(self, name: str, gens: list[str], schema: str) -> DataFrame:
        return (self.spark.read.schema(f"{schema}, gen string").option("basePath", f"{self.path}/{name}")
                .parquet(*[f"{self.path}/{name}/gen={g}" for g in gens]))

    def _stats_schema(self, rows: T.StructType) -> str:
        types = {f.name: f.dataType.simpleString() for f in rows}
        return "bucket int, n long, segments long, " + ", ".join(
            f"{end}_{k} {types[k]}" for k in self.key for end in ("low", "high"))

    def rows_by_generation(self, state: State) -> dict[str, int]:
        """Rows of each live generation that has any, from the statistics."""
        if not state.live:
            return {}
        n = self._side("_stats", state.live, "n long").groupBy("gen").agg(F.sum("n"))
        return dict(n.collect())                                        # a row per live generation at most

    def may_hold(self, keys: DataFrame, state: State) -> DataFrame:
        """(key columns, gen, bucket) of every place where a key may be, by key ranges and Bloom segments: never misses
        one that is there."""
        own = keys.select(*self.key).withColumn("bucket", self._bucket())
        schema = T.StructType.fromJson(json.loads(state.schema))
        stats = self._side("_stats", state.live, self._stats_schema(schema))
        # one row per generation and bucket: their number is bounded by compaction
        near = own.join(F.broadcast(stats), "bucket")
        for k in self.key:
            near = near.where((F.col(k) >= F.col(f"low_{k}")) & (F.col(k) <= F.col(f"high_{k}")))
        near = near.withColumn("segment", _segment(self.key, F.col("segments")))
        bloom = self._side("_bloom", state.live, "bucket int, segment long, bits binary")
        hit = near.join(bloom, ["gen", "bucket", "segment"])
        for i in range(PROBES):
            hit = hit.where(_bit(F.col("bits"), _probe(self.key, i)))
        return hit.select(*self.key, "gen", "bucket")

    def present(self, keys: DataFrame, state: State | None = None) -> DataFrame:
        """(key columns, gen) of the given keys that the table holds; only folders that may hold one are opened."""
        state = state or self.ledger.state()
        if not state.live:
            return keys.select(*self.key).limit(0).withColumn("gen", F.lit(None).cast("string"))
        maybe = cut_lineage(self.may_hold(keys, state))
        parts: dict[str, list[int]] = {}
        for r in maybe.select("gen", "bucket").distinct().collect():          # at most live generations x buckets
            parts.setdefault(r["gen"], []).append(r["bucket"])
        held = self.read(state, {g: sorted(b) for g, b in parts.items()}).select(*self.key, "gen")
        return held.join(maybe.select(*self.key, "gen").distinct(), [*self.key, "gen"], "left_semi")

    # ---- writing ------------------------------------------------------------------------------------------------

    def write_generation(self, rows: DataFrame, gen: str) -> int:
        """Writes a generation's rows, statistics and filters; returns its number of rows. Not yet part of the table."""
        data = f"{self.path}/gen={gen}"
        b = rows.withColumn("bucket", self._bucket())
        # a large batch spreads each bucket over several tasks; adaptive execution puts the parts of a small one together
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions", "200")) // self.buckets)
        (b.repartition("bucket", F.pmod(F.xxhash64(F.lit("file"), *self.key), F.lit(parts)))
         .sortWithinPartitions("bucket", *self.key)
         .write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(data))
        back = self.spark.read.schema(b.schema).parquet(data)
        n = F.count(F.lit(1))
        stats = back.groupBy("bucket").agg(
            n.alias("n"), F.greatest(F.lit(1), F.ceil(n * BITS_PER_KEY / SEGMENT_BITS)).cast("long").alias("segments"),
            *[e for k in self.key for e in (F.min(k).alias(f"low_{k}"), F.max(k).alias(f"high_{k}"))])
        stats.write.mode("overwrite").parquet(f"{self.path}/_stats/gen={gen}")
        stats = self.spark.read.schema(self._stats_schema(b.schema)).parquet(f"{self.path}/_stats/gen={gen}")
        keyed = back.select("bucket", *self.key).join(F.broadcast(stats.select("bucket", "segments")), "bucket")
        bits = keyed.select("bucket", _segment(self.key, F.col("segments")).alias("segment"),
                            F.explode(F.array(*[_probe(self.key, i) for i in range(PROBES)])).alias("bit"))
        (bits.groupBy("bucket", "segment").agg(F.bitmap_construct_agg("bit").alias("bits"))
         .write.mode("overwrite").parquet(f"{self.path}/_bloom/gen={gen}"))
        return stats.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def commit_batch(self, write, source: str | None = None, epoch: int | None = None) -> State:
        """Runs ``write(state, gen)`` (rows written; replaced generations) and commits its generation; again on the newer
        state if another writer was faster; not at all if the epoch of this source is known."""
        while True:
            old = self.ledger.state()
            if source is not None and epoch is not None and old.applied.get(source, -1) >= epoch:
                return old
            gen = f"{old.version + 1:08d}-{uuid.uuid4().hex[:8]}"
            n, gone, schema = write(old, gen)
            state = State(old.version + 1, [g for g in old.live if g not in gone] + ([gen] if n else []),
                          dict(old.applied), old.schema or schema)
            if source is not None and epoch is not None:
                state.applied[source] = epoch
            try:
                self.ledger.commit(state)
                return state
            except Conflict:
                continue

    def insert_absent(self, batch: DataFrame, source: str | None = None, epoch: int | None = None) -> State:
        """Appends the rows of ``batch`` (one per key) whose key the table does not hold. Rows with a null in the key
        never equal another and are always new."""
        staged = cut_lineage(batch)             # read by the probes, the join and, after a conflict, again

        def write(state: State, gen: str):
            new = staged
            if state.live:
                new = staged.join(self.present(staged, state).select(*self.key), self.key, "left_anti")
            return self.write_generation(new, gen), (), batch.schema.json()

        return self.commit_batch(write, source, epoch)

    def compact(self) -> State:
        """Rewrites the live generations as one."""
        def write(state: State, gen: str):
            rows = self.read(state)
            if rows is None:
                return 0, (), None
            return self.write_generation(rows.drop("gen", "bucket"), gen), state.live, state.schema

        return self.commit_batch(write)


def _segment(key: list[str], segments: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("segment"), *key), segments)


def _probe(key: list[str], i: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(f"probe{i}"), *key), F.lit(SEGMENT_BITS))


def _bit(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, (at % 8).cast("int")) == 1
