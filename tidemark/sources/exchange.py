"""Small exchange formats: headerless CSV lists (S15), digest text lists (S17), pattern configuration JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import pattern_from_query, ts14_format, ts14_parse

MISSING_SCHEMA = "url string, timestamp string, digest string"
INVALID_SCHEMA = "url string, timestamp string, expected string, actual string"
PATTERN_CONFIG_SCHEMA = "id long, query string, name string, slug string, sort int, path string, compression int"


def write_missing(df: DataFrame, path: str) -> None:
    """S15 out: url, 14-digit timestamp, expected digest (no header)."""
    df.select("url", ts14_format("captured_at").alias("timestamp"), "digest").write.mode("overwrite").csv(path)


def read_missing(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema(MISSING_SCHEMA).csv(path)
            .select("url", ts14_parse("timestamp").alias("captured_at"), "digest"))


def write_invalid(df: DataFrame, path: str) -> None:
    df.select("url", ts14_format("captured_at").alias("timestamp"), "expected", "actual").write.mode("overwrite").csv(path)


def read_invalid(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema(INVALID_SCHEMA).csv(path)
            .select("url", ts14_parse("timestamp").alias("captured_at"), "expected", "actual"))


def read_digest_list(spark: SparkSession, path: str) -> DataFrame:
    """One digest per line, de-duplicated."""
    return spark.read.text(path).select(F.col("value").alias("digest")).distinct()


def read_pattern_config(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Pattern configuration (query string -> SURT + prefix flag). ``multi_line`` for a pretty-printed JSON
    array file; False for JSON lines."""
    c = spark.read.schema(PATTERN_CONFIG_SCHEMA).option("multiLine", multi_line).json(path)
    p = pattern_from_query("query")
    return c.select("id", p["surt"].alias("surt"), p["prefix"].alias("prefix"), "name", "slug",
                    F.col("sort").alias("sort_id"), "path", "compression")
