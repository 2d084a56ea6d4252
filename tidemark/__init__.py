"""tidemark: web-archive capture analytics on Spark.

Sub-packages:
  functions/  Column -> Column scalar functions (SURT, timestamps, digests, URLs, text)
  sources/    readers for CDX pages, snapshot stores, redirect files, CSV exchange lists
  operators/  set-based jobs: de-duplication, upserts, reconciliation, extraction, search, quality
  plans/      derived fixture tables and the query catalogue used by ``__spark_entry__``
  streaming/  incremental ingest with Structured Streaming
"""

from tidemark.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
