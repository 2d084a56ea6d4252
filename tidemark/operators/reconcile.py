"""Reconciling captures with the body store: missing bodies, wrong digests, discovery, set differences.

Natural keys replace surrogate ids: a capture is (surt, captured_at) (``capture_id`` is carried when present), a
snapshot is its digest. Every "NOT EXISTS" is a ``left_anti`` join; filters are applied before joins so they reach
the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.dedup import first_by

CAPTURE_KEY = ["surt", "captured_at"]


def worth_fetching(df: DataFrame, mime: str | None = "text/html") -> DataFrame:
    """F1 + F2: mime type equals (when given) and status NULL or 200."""
    pred = F.col("status_code").isNull() | (F.col("status_code") == 200)
    if mime is not None:
        pred = pred & (F.col("mime_type") == mime)
    return df.where(pred)


def missing_captures(entries: DataFrame, success: DataFrame, mime: str | None = "text/html",
                     limit: int | None = None) -> DataFrame:
    """J1 (+K3): captures worth fetching that have no success row. With ``limit`` the first rows by
    (surt, captured_at) are returned (the order makes the limit deterministic)."""
    out = worth_fetching(entries, mime).join(success.select(*CAPTURE_KEY), CAPTURE_KEY, "left_anti")
    if limit is not None:
        out = out.orderBy(*CAPTURE_KEY).limit(limit)
    return out


def missing_best_per_digest(missing: DataFrame, ordered: bool = False) -> DataFrame:
    """Per expected digest the capture with the shortest URL (bytes), then the earliest time, then the URL.
    Output (url, captured_at, digest); ``ordered`` sorts by url, captured_at, digest as the export does."""
    best = first_by(missing.select("url", "captured_at", "digest"), ["digest"],
                    [F.octet_length("url"), F.col("captured_at"), F.col("url")], ["url", "captured_at"])
    best = best.select("url", "captured_at", "digest")
    return best.orderBy("url", "captured_at", "digest") if ordered else best


def snapshot_info(entries: DataFrame, success: DataFrame, pattern_entry: DataFrame, patterns: DataFrame,
                  mime: str | None = "text/html") -> DataFrame:
    """Snapshot x success x capture x collection membership x collection, for one mime type.
    Output (snapshot, capture_id, surt, captured_at, slug, sort_id)."""
    e = entries.select("capture_id", "mime_type")
    if mime is not None:
        e = e.where(F.col("mime_type") == mime)
    s = success.select("capture_id", "surt", "captured_at", "snapshot")
    pe = pattern_entry.select("capture_id", "slug")
    p = patterns.where(F.coalesce(F.col("active"), F.lit(True))).select("slug", "sort_id")
    return (s.join(e, "capture_id").join(pe, "capture_id").join(p, "slug")
            .select("snapshot", "capture_id", "surt", "captured_at", "slug", "sort_id"))


def representative(info: DataFrame) -> DataFrame:
    """E5: one capture per snapshot: earliest capture time, then slug, then SURT (explicit total order)."""
    return first_by(info, ["snapshot"], ["captured_at", "slug", "surt"], ["surt", "captured_at", "slug", "capture_id"])


def invalid_digests(entries: DataFrame, success: DataFrame, ordered: bool = False) -> DataFrame:
    """Successes whose body did not hash to the CDX digest -> (url, captured_at, expected, actual)."""
    bad = success.where(~F.col("correct_digest")).select("capture_id", F.col("snapshot").alias("actual"))
    out = bad.join(entries.select("capture_id", "url", "captured_at", F.col("digest").alias("expected")), "capture_id")
    out = out.select("url", "captured_at", "expected", "actual")
    return out.orderBy("url", "captured_at") if ordered else out


def local_discovery(missing: DataFrame, store_digests: DataFrame) -> DataFrame:
    """Missing captures whose expected body is already in the store become success rows (correct digest)."""
    return (missing.join(store_digests.select("digest"), "digest", "left_semi")
            .select("capture_id", "surt", "captured_at", F.col("digest").alias("snapshot"),
                    F.lit(True).alias("correct_digest")))


def invalid_reconcile(invalid: DataFrame, store_digests: DataFrame, entries: DataFrame) -> DataFrame:
    """For (expected, actual) pairs with expected NOT stored and actual stored, every capture with the
    expected digest gets a success row pointing at the actual body (correct_digest = false)."""
    pairs = invalid.select("expected", "actual").distinct()
    stored = store_digests.select("digest")
    pairs = (pairs.join(stored.withColumnRenamed("digest", "expected"), "expected", "left_anti")
             .join(stored.withColumnRenamed("digest", "actual"), "actual", "left_semi"))
    caps = entries.select("capture_id", "surt", "captured_at", F.col("digest").alias("expected"))
    return (caps.join(pairs, "expected")
            .select("capture_id", "surt", "captured_at", F.col("actual").alias("snapshot"),
                    F.lit(False).alias("correct_digest"))
            .dropDuplicates(["capture_id", "snapshot"]))


def unknown_digests(digest_list: DataFrame, cdx_digests: DataFrame, redirect_digests: DataFrame,
                    ordered: bool = False) -> DataFrame:
    """Digests of the list found neither in CDX rows nor in the redirect dataset."""
    out = (digest_list.select("digest").distinct()
           .join(cdx_digests.select("digest"), "digest", "left_anti")
           .join(redirect_digests.select("digest"), "digest", "left_anti"))
    return out.orderBy("digest") if ordered else out


def unknown_digest_counts(digest_list: DataFrame, cdx_digests: DataFrame, redirect_digests: DataFrame) -> DataFrame:
    """Listed (distinct), found in CDX, known (CDX rows, not distinct), found only in redirects, missing."""
    lst = digest_list.select("digest").distinct()
    in_cdx = cdx_digests.select("digest").distinct().withColumn("in_cdx", F.lit(True))
    in_red = redirect_digests.select("digest").distinct().withColumn("in_red", F.lit(True))
    flagged = lst.join(in_cdx, "digest", "left").join(in_red, "digest", "left")
    known = cdx_digests.select(F.count(F.lit(1))).scalar()
    return flagged.agg(
        F.count(F.lit(1)).alias("listed"),
        F.count_if(F.col("in_cdx").isNotNull()).alias("found"),
        known.alias("known"),
        F.count_if(F.col("in_cdx").isNull() & F.col("in_red").isNotNull()).alias("redirect_found"),
        F.count_if(F.col("in_cdx").isNull() & F.col("in_red").isNull()).alias("missing"))


def import_candidates(legacy: DataFrame, stored_digests: DataFrame, redirect_digests: DataFrame) -> DataFrame:
    """Legacy bodies whose digest is neither stored nor a known redirect."""
    known = stored_digests.select("digest").unionByName(redirect_digests.select("digest"))
    return legacy.join(known, "digest", "left_anti")


def captures_by_digest(entries: DataFrame, digests: DataFrame) -> DataFrame:
    """Captures (with their SURT) whose expected digest is in the given list."""
    return entries.join(digests.select("digest").distinct(), "digest", "left_semi")


def redirect_hops(entries: DataFrame, redirects: DataFrame) -> DataFrame:
    """302 captures joined to the redirect dataset on digest; when a digest appears on several lines the
    last line wins. Output (url, captured_at, digest, target)."""
    last = redirects.groupBy("digest").agg(F.max_by("url", F.struct("file", "line_no")).alias("target"))
    caps = entries.where(F.col("status_code") == 302).select("url", "captured_at", "digest")
    return caps.join(last, "digest").select("url", "captured_at", "digest", "target")
