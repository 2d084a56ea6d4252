"""Incremental ingest is first-wins and idempotent (running again over the same files adds nothing)."""

import uuid

from pyspark.sql import functions as F

from tidemark.plans import fixtures as fx
from tidemark.session import checkpoint_dir
from tidemark.sources import cdx
from tidemark.streaming.ingest import ingest


def test_ingest_twice_same_table(spark, sf_small):
    base = checkpoint_dir(spark, f"t-stream-{uuid.uuid4().hex}")
    cr = fx.crawl(spark, sf_small)
    cdx.write_pages(cr.where("page = 0").drop("page"), f"{base}/pages/run=0")
    ingest(spark, f"{base}/pages", f"{base}/table", f"{base}/ckpt")
    n1 = spark.read.parquet(f"{base}/table").count()
    cdx.write_pages(cr.where("page = 1").drop("page"), f"{base}/pages/run=1")
    ingest(spark, f"{base}/pages", f"{base}/table", f"{base}/ckpt")
    ingest(spark, f"{base}/pages", f"{base}/table", f"{base}/ckpt")
    t = spark.read.parquet(f"{base}/table")
    assert t.count() == n1 == fx.captures(spark, sf_small).count()
    # the re-crawl (status 404 a day later) did not overwrite the first capture rows
    assert t.where(F.col("status_code") == 404).count() == \
        fx.captures(spark, sf_small).where(F.col("status_code") == 404).count()
