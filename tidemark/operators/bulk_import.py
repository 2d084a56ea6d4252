"""Bulk import of bodies into the content-addressed store, as a staged and restartable job.

An import has a name and two committed stages below ``<store>/_imports/<name>/``:

1. ``plan``: one row per file found in the source, from listings alone: ``candidate``, ``skipped`` (stored already, or
   a known redirect) or ``rejected`` (the path breaks the layout).
2. ``done``: one row per candidate after its file was read: ``written``, ``skipped`` (another file of the same
   digest was taken) or ``rejected`` (undecodable, or a body that is not what its name says).

A stage counts once its folder holds ``_SUCCESS``. A job that dies is run again under the same name: a committed plan is
taken as it is, so files that the dead run wrote already are still reported as written, and bodies are
content-addressed, so writing one again changes nothing. Bodies are read and written by the task that holds their
path; only paths and digests are shuffled.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import store as stg

MANIFEST = ["path", "length", "digest", "outcome", "reason", "written_bytes"]
_CODEC = {"legacy": "gzip", "gzip": "gzip", "plain": "plain"}


def plan_import(candidates: DataFrame, stored: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(path, length, digest, outcome, reason) for scanned files (path, length, digest, reject): rejects by
    path, digests that the store holds, digests of known redirects, and the candidates that are left."""
    known = stored.select("digest", F.lit("stored").alias("known"))
    if redirects is not None:
        known = known.unionByName(redirects.select("digest", F.lit("redirect").alias("known")))
    known = known.groupBy("digest").agg(F.max("known").alias("known"))             # 'stored' before 'redirect'
    outcome = (F.when(F.col("reject").isNotNull(), "rejected").when(F.col("known").isNotNull(), "skipped")
               .otherwise("candidate"))
    return (candidates.join(known, "digest", "left")
            .select("path", "length", "digest", outcome.alias("outcome"), F.coalesce("reject", "known").alias("reason")))


def _sha1_base32(body: bytes) -> str:
    import base64
    import hashlib
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def write_candidates(plan: DataFrame, source: str, store_root: str, layout: str, verify: bool = True) -> DataFrame:
    """(path, outcome, reason, written_bytes) per candidate of ``plan``.

    Files of one digest meet in one task, in path order: the first readable one is written, the rest are skipped unread
    (a digest with very many files costs rows, not reads). With ``verify`` a body that does not hash to its digest is
    rejected; without, it is filed under its name as it is and left to store validation."""
    import pyarrow.fs as pafs
    spark = plan.sparkSession
    src_uri, out_uri = stg._shared_uri(spark, source), stg._shared_uri(spark, store_root)
    codec = _CODEC[layout]

    def run(batches):
        import zstandard
        src, src_base = pafs.FileSystem.from_uri(src_uri)
        out, out_base = pafs.FileSystem.from_uri(out_uri)
        compress = zstandard.ZstdCompressor(level=stg.ZSTD_LEVEL).compress
        taken = None

        def one(path, digest):
            with src.open_input_stream(f"{src_base.rstrip('/')}/{path}", compression=None) as f:
                body, error = stg.DECODERS[codec](f.read())
            if error:
                return "rejected", error, None
            if verify and _sha1_base32(body) != digest:
                return "rejected", "digest", None
            data = compress(body)
            stg._put(out, f"{out_base.rstrip('/')}/{digest[:2]}/{digest[2:4]}/{digest}.zst", data)
            return "written", None, len(data)

        for pdf in batches:
            rows = []
            for path, digest in zip(pdf["path"], pdf["digest"]):
                result = ("skipped", "duplicate", None) if digest == taken else one(path, digest)
                if result[0] == "written":
                    taken = digest
                rows.append((path, *result))
            got = pd.DataFrame(rows, columns=["path", "outcome", "reason", "written_bytes"])
            yield got.astype({"written_bytes": "Int64"})

    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return (plan.where(F.col("outcome") == "candidate").select("path", "digest").repartition(n, "digest")
            .sortWithinPartitions("digest", "path")
            .mapInPandas(run, "path string, outcome string, reason string, written_bytes long"))


def _committed(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def stored_digests(spark: SparkSession, store_root: str) -> DataFrame:
    """Digests that the store holds, by a listing; none where the store is not there yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(store_root)
    if not p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
        return spark.createDataFrame([], "digest string")
    return stg.list_store(spark, store_root).where("path_ok").select("digest")


def run_import(spark: SparkSession, source: str, store_root: str, name: str, layout: str = "legacy",
               redirects: DataFrame | None = None, verify: bool = True) -> DataFrame:
    """Imports the bodies below ``source`` into the store; returns the manifest: one row (``MANIFEST``) per file found.

    Calling it again with the same ``name`` finishes an interrupted import, or returns the manifest of a finished one;
    a new name over the same source finds everything stored and writes nothing."""
    home = f"{store_root.rstrip('/')}/_imports/{name}"
    if not _committed(spark, f"{home}/plan"):
        plan = plan_import(stg.scan_candidates(spark, source, layout), stored_digests(spark, store_root), redirects)
        plan.write.mode("overwrite").parquet(f"{home}/plan")
    plan = spark.read.parquet(f"{home}/plan")
    if not _committed(spark, f"{home}/done"):
        write_candidates(plan, source, store_root, layout, verify).write.mode("overwrite").parquet(f"{home}/done")
    return manifest(spark, store_root, name)


def manifest(spark: SparkSession, store_root: str, name: str) -> DataFrame:
    """The manifest of an import; before its second stage is committed, candidates are still named so."""
    home = f"{store_root.rstrip('/')}/_imports/{name}"
    plan = spark.read.parquet(f"{home}/plan")
    if not _committed(spark, f"{home}/done"):
        return plan.withColumn("written_bytes", F.lit(None).cast("long")).select(*MANIFEST)
    done = spark.read.parquet(f"{home}/done").toDF("path", "after", "why", "written_bytes")
    return plan.join(done, "path", "left").select(
        "path", "length", "digest", F.coalesce("after", "outcome").alias("outcome"),
        F.coalesce("why", "reason").alias("reason"), "written_bytes")
