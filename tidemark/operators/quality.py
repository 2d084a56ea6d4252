"""Data-quality jobs (Q1-Q8, W1): store validation, digest recomputation, redirect dataset checks, fetch checks.

All checks are column expressions plus joins/aggregates; the sortedness check compares each line with its
predecessor through an equi-join on (file, line_no - 1) instead of a per-file window, so no file is funnelled
through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import (content_digest, digest_from_store_path, redirect_file_valid, redirect_html,
                                store_location, store_path_valid)

N_REDIRECT_FILES = 32


def validate_store(files: DataFrame) -> DataFrame:
    """Q1: (path, expected, actual, status) with status ok / invalid_digest / unexpected_path / io_error
    (body unreadable = NULL). ``files`` has (path, body)."""
    expected = digest_from_store_path("path")
    actual = content_digest(F.col("body"))
    status = (F.when(~store_path_valid("path"), F.lit("unexpected_path"))
              .when(F.col("body").isNull(), F.lit("io_error"))
              .when(actual != expected, F.lit("invalid_digest"))
              .otherwise(F.lit("ok")))
    return files.select("path", F.when(store_path_valid("path"), expected).alias("expected"),
                        actual.alias("actual"), status.alias("status"))


def invalid_files(validated: DataFrame) -> DataFrame:
    """Q2: files with a wrong digest or an unreadable body."""
    return validated.where(F.col("status").isin("invalid_digest", "io_error"))


def digests_by_prefix(files: DataFrame, prefix: str | None = None) -> DataFrame:
    """Q3 (+F10): (expected, actual) for every file, or for expected digests starting with ``prefix``."""
    f = files.withColumn("expected", digest_from_store_path("path"))
    if prefix:
        f = f.where(F.col("expected").startswith(prefix))
    return f.select("expected", content_digest(F.col("body")).alias("actual"))


def check_incoming(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Q4: for incoming (name, body): NULL location when the named digest is already stored; else the target
    location when the body hashes to its name, else the real digest; an invalid name is an error."""
    named = incoming.withColumn("named", F.substring("name", 1, 32))
    flagged = named.join(stored.select(F.col("digest").alias("named"), F.lit(True).alias("stored")), "named", "left")
    actual = content_digest(F.col("body"))
    return flagged.select(
        "name",
        F.when(store_location("named").isNull(), F.lit("error"))
         .when(F.col("stored").isNotNull(), F.lit("stored"))
         .when(actual == F.col("named"), F.lit("new"))
         .otherwise(F.lit("mismatch")).alias("outcome"),
        F.when(F.col("stored").isNull() & (actual == F.col("named")), store_location("named")).alias("location"),
        F.when(F.col("stored").isNull() & (actual != F.col("named")), actual).alias("actual"))


def validate_redirect_lines(lines: DataFrame) -> DataFrame:
    """Q5: a line is good when its digest equals the digest of the canned redirect body for its URL."""
    ok = F.col("url").isNotNull() & (content_digest(redirect_html(F.col("url"))) == F.col("digest"))
    return lines.withColumn("line_ok", F.coalesce(ok, F.lit(False)))


def sortedness(lines: DataFrame) -> DataFrame:
    """Per line, whether it is strictly greater (bytes) than the previous line of its file (first line: true)."""
    prev = lines.select("file", (F.col("line_no") + 1).alias("line_no"), F.col("line").alias("prev_line"))
    j = lines.join(prev, ["file", "line_no"], "left")
    return j.withColumn("in_order", F.col("prev_line").isNull() | (F.col("line") > F.col("prev_line")))


def validate_redirect_files(lines: DataFrame) -> DataFrame:
    """Q6 per file: name validity, line count, bad lines, out-of-order lines, sorted flag."""
    checked = sortedness(validate_redirect_lines(lines))
    return (checked.groupBy("file")
            .agg(F.count(F.lit(1)).alias("n_lines"),
                 F.count_if(~F.col("line_ok")).alias("bad_lines"),
                 F.count_if(~F.col("in_order")).alias("unsorted_lines"))
            .select("file", redirect_file_valid("file").alias("name_ok"), "n_lines", "bad_lines", "unsorted_lines",
                    (F.col("unsorted_lines") == 0).alias("sorted")))


def redirect_verdict(per_file: DataFrame) -> DataFrame:
    """Q6 dataset verdict: 32 files, all names valid, all sorted, no bad lines."""
    agg = per_file.agg(F.count(F.lit(1)).alias("n_files"), F.count_if(~F.col("name_ok")).alias("bad_names"),
                       F.count_if(~F.col("sorted")).alias("unsorted_files"),
                       F.sum("bad_lines").cast("bigint").alias("bad_lines"))
    return agg.withColumn("valid", (F.col("n_files") == N_REDIRECT_FILES) & (F.col("bad_names") == 0)
                          & (F.col("unsorted_files") == 0) & (F.col("bad_lines") == 0))


def redirect_guess(rows: DataFrame) -> DataFrame:
    """Q7: (url, captured_at, digest, location): does the canned redirect body for ``location`` hash to digest?"""
    guess = content_digest(redirect_html(F.col("location")))
    return rows.select("url", "captured_at", "digest", "location", guess.alias("guessed"),
                       (guess == F.col("digest")).alias("match"))


def fetched_check(wanted: DataFrame, fetched: DataFrame) -> DataFrame:
    """Q8: wanted (url, captured_at, digest) joined with fetched (url, captured_at, body): real digest, whether it
    matches, and the store location the body is filed under (its real digest). Bodies are hashed where they are, so only
    their digests meet the wanted rows."""
    hashed = fetched.select("url", "captured_at", content_digest(F.col("body")).alias("actual"))
    actual = F.col("actual")
    return wanted.join(hashed, ["url", "captured_at"]).select(
        "url", "captured_at", F.col("digest").alias("expected"), actual,
        (actual == F.col("digest")).alias("match"), store_location(actual).alias("location"))
