"""Collections (URL patterns): capture assignment by exact / prefix SURT match, listing and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import surt_host_key


def assign_patterns(entries: DataFrame, patterns: DataFrame, key_cols=("capture_id", "surt", "captured_at"),
                    pattern_cols=("slug", "sort_id")) -> DataFrame:
    """(pattern columns, capture key) for every capture whose SURT equals an exact pattern or starts with a
    prefix pattern.

    A capture looks prefixes up at the lengths that the patterns of its own host have (one small row per host), so it
    makes as many rows as its host has lengths, however many collections there are. Prefixes that end inside a host
    name belong to no host; their lengths, a scalar, hold for all captures."""
    pc = list(pattern_cols)
    cols = [*pc, *key_cols]
    e = entries.select(*key_cols)
    p = patterns.select(F.col("surt").alias("p_surt"), "prefix", *pc)
    exact, prefixes = p.where(~F.col("prefix")), p.where("prefix")
    return (e.join(exact, e["surt"] == exact["p_surt"]).select(*cols)
            .unionByName(prefix_lookups(e, prefixes).join(prefixes, "p_surt").select(*cols)))


def prefix_lookups(entries: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``entries`` with ``p_surt``, one row per beginning of the SURT that may be one of ``prefixes`` (p_surt)."""
    whole = F.contains(F.col("p_surt"), F.lit(")"))
    lengths = F.collect_set(F.length("p_surt"))              # at most the length of a SURT
    of_host = prefixes.where(whole).groupBy(surt_host_key("p_surt").alias("host")).agg(lengths.alias("lengths"))
    anywhere = prefixes.where(~whole).agg(lengths).scalar()
    looked_up = (entries.withColumn("host", surt_host_key("surt")).join(of_host, "host").drop("host")
                 .unionByName(entries.withColumn("lengths", anywhere)))
    return (looked_up.withColumn("length", F.explode("lengths")).where(F.col("length") <= F.length("surt"))
            .withColumn("p_surt", F.substring(F.col("surt"), F.lit(1), F.col("length"))).drop("lengths", "length"))


def pattern_list(patterns: DataFrame) -> DataFrame:
    """Collections in display order."""
    return patterns.orderBy("sort_id")


def pattern_stats(patterns: DataFrame, pattern_entry: DataFrame, success: DataFrame) -> DataFrame:
    """J6 + E1: per collection the number of distinct captures that have at least one fetched body; collections
    without any keep 0. Successes are reduced to distinct capture keys before the join (no fan-out)."""
    fetched = success.select("capture_id").distinct()
    counted = (pattern_entry.join(fetched, "capture_id", "left_semi")
               .groupBy("slug").agg(F.countDistinct("capture_id").alias("indexed")))
    return (patterns.join(counted, "slug", "left")
            .select("sort_id", "slug", "name", "surt", "prefix",
                    F.coalesce(F.col("indexed"), F.lit(0)).cast("bigint").alias("indexed")))
