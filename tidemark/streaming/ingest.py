"""Incremental CDX ingest and re-indexing.

New page files are picked up by a file stream (the checkpoint records which files were read, replacing the
reference's page bookkeeping). Each micro-batch is decoded and upserted first-wins into a versioned table
(``operators.versioned``), which opens only folders that may hold a key of the batch; unbounded keyed de-duplication
therefore lives in the table, not in stream state. The table's ledger names the stream (by its checkpoint) and the
epoch, so a micro-batch that is replayed after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.dedup import first_by
from tidemark.operators.versioned import VersionedTable
from tidemark.streaming.index import SearchIndex
from tidemark.sources.cdx import decode_rows, page_layout, page_time

KEY = ["surt", "captured_at"]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def _table_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A plain stored table; empty before its first write. A table that is there but can't be read raises."""
    return spark.read.parquet(path) if _exists(spark, path) else like.limit(0)


def cdx_stream(spark: SparkSession, pages_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """Streaming pages (file, page_ts, rows) from a folder of CDX page files; ``files_per_batch`` bounds a
    micro-batch (unset: all files present are one batch, so the earliest page wins over all of them)."""
    r = spark.readStream.option("recursiveFileLookup", True)
    raw = (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).text(pages_dir, wholetext=True)
    file = F.col("_metadata.file_path")
    return raw.select(file.alias("file"), page_time(file).alias("page_ts"),
                      F.from_json("value", "array<array<string>>").alias("rows"))


def captures_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, KEY)


def upsert_batch(batch: DataFrame, table_path: str, source: str | None = None, epoch: int | None = None) -> None:
    """First-wins upsert of one micro-batch: earliest (page_ts, file, pos) per key, minus keys already stored. With
    ``source`` and ``epoch`` a batch is applied once, however often it is run."""
    rows = decode_rows(batch.where(page_layout(F.col("rows")).isNotNull())).where(F.col("_error").isNull())
    rows = rows.drop("_error", "extra_info")
    first = first_by(rows, KEY, ["page_ts", "file", "pos"])
    captures_table(batch.sparkSession, table_path).insert_absent(first, source, epoch)


def ingest(spark: SparkSession, pages_dir: str, table_path: str, checkpoint: str) -> None:
    """Run X1 over every file present now (availableNow) and stop; re-running picks up only new files."""
    q = (cdx_stream(spark, pages_dir).writeStream
         .foreachBatch(lambda df, epoch: upsert_batch(df, table_path, checkpoint, epoch))
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def reindex(spark: SparkSession, docs_dir: str, schema: str, index_path: str, checkpoint: str) -> None:
    """File stream of new, changed or deleted document rows (parquet) -> search index, availableNow."""
    index = SearchIndex(spark, index_path)
    q = (spark.readStream.schema(schema).parquet(docs_dir).writeStream
         .foreachBatch(lambda df, epoch: index.apply(df, checkpoint, epoch))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
