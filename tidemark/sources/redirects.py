"""Redirect dataset (S6, S7, B21, B22): headerless 'digest,url' lines in 32 files redirects-<prefix>.csv.

Lines are split on the first comma (no CSV quoting). Line numbers are exact and contiguous per file without a
per-file window: rows of one file split are consecutive inside one task, so line = (lines of earlier splits of the
file) + (position inside the split); only the small per-split table is windowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import redirect_file_valid
from tidemark.functions.urls import REDIRECT_FILE_PREFIXES


def number_lines(text: DataFrame) -> DataFrame:
    """(file, line_no 1-based, line) for a DataFrame read with ``spark.read.text``."""
    df = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.col("value").alias("line"), F.monotonically_increasing_id().alias("mid"))
    blocks = df.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("mid0"))
    w = Window.partitionBy("file").orderBy("block")
    blocks = blocks.withColumn("before", F.sum("n").over(w) - F.col("n"))
    j = df.join(blocks.select("file", "block", "before", "mid0"), ["file", "block"])
    return j.select("file", (F.col("before") + F.col("mid") - F.col("mid0") + 1).alias("line_no"), "line")


def read_redirects(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line, digest, url) from every file under ``path``."""
    lines = number_lines(spark.read.option("recursiveFileLookup", True).text(path))
    return lines.select("file", "line_no", "line", F.substring_index("line", ",", 1).alias("digest"),
                        F.when(F.instr("line", ",") > 0, F.expr("substr(line, instr(line, ',') + 1)")).alias("url"))


def export_digests(redirects: DataFrame) -> DataFrame:
    """Digests in file order (file name, then line)."""
    return redirects.select("file", "line_no", "digest").orderBy("file", "line_no")


def file_prefixes(spark: SparkSession) -> DataFrame:
    """The 32 valid file prefixes as a relation."""
    return spark.range(1).select(F.explode(F.split(F.lit(REDIRECT_FILE_PREFIXES), "")).alias("prefix")).where("prefix <> ''")


def write_redirects(lines: DataFrame, path: str) -> None:
    """U3 sink: one folder ``file=redirects-<prefix>.csv`` per prefix, lines sorted inside it (range partitioning keeps
    its parts ordered)."""
    name = F.concat(F.lit("redirects-"), F.substring("line", 1, 1), F.lit(".csv"))
    (lines.select(name.alias("file"), "line").distinct()
     .repartitionByRange("file", "line").sortWithinPartitions("file", "line")
     .write.mode("overwrite").partitionBy("file").text(path))


__all__ = ["number_lines", "read_redirects", "export_digests", "file_prefixes", "write_redirects",
           "redirect_file_valid"]
