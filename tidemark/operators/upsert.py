"""Insert-if-absent upserts (I1-I10) as set operations: de-duplicate the batch, anti-join the table, append.

Appends go to a new versioned folder under the table root, so a failed job leaves the previous version readable and
a re-run recomputes the same delta (idempotent): the caller publishes the new version when the write succeeded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.dedup import capture_dedup, first_by

CAPTURE_KEY = ["surt", "captured_at"]


def new_keys(batch: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct key values of the batch that the table does not hold yet."""
    keys = list(keys)
    return batch.select(*keys).distinct().join(table.select(*keys), keys, "left_anti")


def insert_entries(table: DataFrame, crawl: DataFrame) -> DataFrame:
    """Captures to append. Within the batch the first row of a (surt, captured_at) in crawl order wins; rows
    whose key is already stored are ignored (their later status/digest is dropped, as the first write wins)."""
    return capture_dedup(crawl).join(table.select(*CAPTURE_KEY), CAPTURE_KEY, "left_anti")


def insert_success(table: DataFrame, batch: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I4 (+I3): (new success rows on (capture, snapshot, correct_digest), new snapshot digests)."""
    key = ["capture_id", "snapshot", "correct_digest"]
    rows = batch.dropDuplicates(key).join(table.select(*key), key, "left_anti")
    snaps = new_keys(rows.select(F.col("snapshot").alias("digest")), snapshots, ["digest"])
    return rows, snaps


def insert_pattern_entry(table: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert-or-ignore (slug, capture_id) memberships."""
    return new_keys(batch, table, ["slug", "capture_id"])


def insert_patterns(table: DataFrame, batch: DataFrame) -> DataFrame:
    """A pattern is new when neither its (surt, prefix) nor its sort_id is taken (within the batch the lowest
    sort_id wins a (surt, prefix) clash)."""
    first = first_by(batch, ["surt", "prefix"], ["sort_id", "slug"])
    first = first_by(first, ["sort_id"], ["surt", "slug"])
    return (first.join(table.select("surt", "prefix"), ["surt", "prefix"], "left_anti")
            .join(table.select("sort_id"), ["sort_id"], "left_anti"))


def append_failures(table: DataFrame, batch: DataFrame) -> DataFrame:
    """Failures are plain appends (no key)."""
    return table.unionByName(batch.select(*table.columns))


def set_pattern_updated(patterns: DataFrame, updates: DataFrame) -> DataFrame:
    """New ``updated`` time for listed slugs; returns the patterns table with a flag telling which existed."""
    u = updates.select("slug", F.col("updated").alias("new_updated"), F.lit(True).alias("touched"))
    cols = [c for c in patterns.columns if c != "updated"]
    base = patterns if "updated" in patterns.columns else patterns.withColumn("updated", F.lit(None).cast("timestamp"))
    return (base.join(u, "slug", "left")
            .select(*cols, F.coalesce("new_updated", "updated").alias("updated"),
                    F.coalesce("touched", F.lit(False)).alias("touched")))
