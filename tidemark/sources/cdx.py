"""CDX index pages (S1-S5, S16): JSON arrays of string arrays, first row = header.

Pages are read whole (``wholetext``; ``.json``, ``.gz`` and ``.json.zst`` are decoded by the text source), parsed with
``from_json`` and flattened with ``posexplode``. Decoding is header-driven, so the short (7), full (11) and other
column orders all decode; a row that does not decode lands in ``_error`` instead of failing the page (D15).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import (checked_long, digest_kind, status_code, status_code_error, surt_parse, ts14_format,
                                ts14_parse)

# The two header layouts of CDX pages.
SHORT_HEADER = ["urlkey", "timestamp", "original", "mimetype", "statuscode", "digest", "length"]
FULL_HEADER = ["urlkey", "timestamp", "original", "mimetype", "statuscode", "digest", "redirect", "robotflags",
               "length", "offset", "filename"]
REQUIRED = ["timestamp", "original", "mimetype", "statuscode", "digest", "length"]


def page_time(file: Column) -> Column:
    """Crawl time of a page from its folder (``page=<epoch ms>``) or its file name (``<epoch ms>.json[.zst|.gz]``)."""
    folder = F.regexp_extract(file, r"page=([0-9]+)", 1)
    name = F.regexp_extract(file, r"/([0-9]+)\.json(?:\.zst|\.gz)?$", 1)
    ms = F.when(folder != "", folder).when(name != "", name)
    return F.timestamp_millis(ms.cast("long"))


def read_pages(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per page: (file, page_ts from the folder/file name as epoch ms, rows array<array<string>>).
    ``glob`` restricts file names (e.g. '*.json*' for a store that also holds other files)."""
    r = spark.read.option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    raw = r.text(path, wholetext=True)  # (an .option('wholetext') would be reset by text()'s default)
    file = F.col("_metadata.file_path")
    return raw.select(file.alias("file"), page_time(file).alias("page_ts"),
                      F.from_json("value", "array<array<string>>").alias("rows"))


def page_layout(rows: Column) -> Column:
    """S2: 'short' / 'full' for the two known headers, 'other' for another order holding the required names,
    NULL for a page that cannot be decoded."""
    head = F.element_at(rows, 1)
    has_all = F.lit(True)
    for n in REQUIRED:
        has_all = has_all & F.array_contains(head, n)
    return (F.when(head == F.array(*[F.lit(x) for x in SHORT_HEADER]), F.lit("short"))
            .when(head == F.array(*[F.lit(x) for x in FULL_HEADER]), F.lit("full"))
            .when(has_all, F.lit("other")))


def decode_rows(pages: DataFrame) -> DataFrame:
    """S3: typed captures from pages; each row keeps (file, pos) for crawl order. Rows whose key, timestamp,
    status, digest, length or (full layout) offset do not parse carry an ``_error`` text. Pages without a usable header are dropped (see ``reject_pages``)."""
    p = pages.withColumn("layout", page_layout(F.col("rows"))).where(F.col("layout").isNotNull())
    p = p.withColumn("header", F.element_at("rows", 1))
    x = p.select("file", "page_ts", "layout", "header", F.posexplode("rows").alias("pos", "r")).where(F.col("pos") > 0)

    def field(name: str) -> Column:
        i = F.array_position(F.col("header"), name)
        return F.when(i > 0, F.try_element_at(F.col("r"), i.cast("int")))

    ts_s, st_s, len_s = field("timestamp"), field("statuscode"), field("length")
    ts = ts14_parse(ts_s)
    err = (F.when(F.size("r") != F.size("header"), F.lit("row length"))
           .when(F.array_contains("header", "urlkey") & surt_parse(field("urlkey")).isNull(), F.lit("key"))
           .when(ts.isNull(), F.lit("timestamp"))
           .when(status_code_error(st_s), F.lit("status"))
           .when(digest_kind(field("digest")) == "error", F.lit("digest"))
           .when(checked_long(len_s).isNull(), F.lit("length"))
           .when((F.col("layout") == "full") & checked_long(field("offset")).isNull(), F.lit("offset")))
    extra = F.when(F.col("layout") == "full", F.struct(
        field("redirect").alias("redirect"), field("robotflags").alias("robot_flags"),
        checked_long(field("offset")).alias("offset"), field("filename").alias("file_name")))
    return x.select(
        "file", "page_ts", F.col("pos").cast("bigint").alias("pos"), "layout",
        field("urlkey").alias("surt"), ts.alias("captured_at"), field("original").alias("original"),
        field("mimetype").alias("mime_type"), status_code(st_s).alias("status_code"), field("digest").alias("digest"),
        checked_long(len_s).alias("length"), extra.alias("extra_info"), err.alias("_error"))


def reject_pages(pages: DataFrame) -> DataFrame:
    """Pages whose header is neither known nor holds the required names, or whose JSON did not parse."""
    return pages.where(F.col("rows").isNull() | page_layout(F.col("rows")).isNull()).select("file", "page_ts")


def page_digests(pages: DataFrame) -> DataFrame:
    """Every digest column value of decodable pages (the header row is skipped: D7)."""
    return decode_rows(pages).select("digest")


def cdx_dump(entries: DataFrame) -> DataFrame:
    """(crawl epoch seconds, status with NULL as 0, mime, original)."""
    return entries.select(F.unix_timestamp("page_ts").alias("crawl_s"),
                          F.coalesce("status_code", F.lit(0)).alias("status"), "mime_type", "original")


def lookup(entries: DataFrame, key: str, exact: bool) -> DataFrame:
    """captures of one SURT (exact) or of every SURT starting with the key (prefix); a plain string predicate
    that reaches the parquet scan."""
    c = F.col("surt")
    return entries.where(c == key if exact else c.startswith(key))


def write_pages(captures: DataFrame, path: str, rows_per_page: int = 10_000) -> None:
    """Write captures as CDX pages (short layout), at most ``rows_per_page`` rows per page, one page per file,
    in a folder of its own named by the page's first crawl time (epoch ms) and its number. Groups are bounded by the page size."""
    row = F.array(F.col("surt"), ts14_format("captured_at"), F.col("url"), F.col("mime_type"),
                  F.coalesce(F.col("status_code").cast("string"), F.lit("-")), F.col("digest"),
                  F.col("length").cast("string"))
    paged = captures.select(F.floor(F.col("capture_id") / rows_per_page).alias("page_no"), "capture_id", "crawl_ts",
                            row.alias("r"))
    pages = (paged.groupBy("page_no")
             .agg(F.min("crawl_ts").alias("t0"),
                  F.sort_array(F.collect_list(F.struct("capture_id", "r"))).alias("rs"))
             .select(F.unix_millis(F.col("t0").cast("timestamp")).alias("page"), "page_no",
                     F.to_json(F.concat(F.array(F.array(*[F.lit(h) for h in SHORT_HEADER])),
                                        F.transform("rs", lambda s: s["r"]))).alias("value")))
    pages.write.mode("overwrite").partitionBy("page", "page_no").option("compression", "none").text(path)


def write_query_log(log: DataFrame, path: str) -> None:
    """S4 query log: one line 'epoch_ms,query_url' per fetched page (D12: the reference wrote them without line
    breaks), appended so repeated crawls accumulate."""
    log.select(F.concat_ws(",", F.col("epoch_ms").cast("string"), F.col("query")).alias("value")) \
        .write.mode("append").text(path)


def read_query_log(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.text(path)
    return t.select(F.substring_index("value", ",", 1).cast("long").alias("epoch_ms"),
                    F.expr("substr(value, instr(value, ',') + 1)").alias("query"))
