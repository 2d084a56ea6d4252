"""Stored tables laid out for their lookups and joins.

* ``write_bucketed`` / ``open_bucketed``: rows dealt by a hash of the join key and sorted by the lookup key inside each
  bucket. Joins on the key need no shuffle on this side, and a lookup skips the row groups whose range it is not in.
  The join key should be an even one (a capture's id), so that a popular URL does not fill one bucket.
* ``write_by_prefix`` / ``read_by_prefix``: rows in folders by the first symbols of a key; a prefix of any length opens
  only its folders (equality on the full levels, a range on the level it ends in, a row filter beyond).
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Symbols per folder level of a prefix layout (the body store's 'AA/BB' levels).
LEVELS = (2, 2)


def _table_name(path: str) -> str:
    return "tidemark_" + hashlib.sha1(path.encode()).hexdigest()[:20]


def _quoted(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'")


def write_bucketed(df: DataFrame, path: str, key: Sequence[str], sort: Sequence[str], buckets: int) -> None:
    """Writes ``df`` as one sorted file per bucket (each bucket is one task's)."""
    name = _table_name(path)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    (df.repartition(buckets, *key).write.mode("overwrite").option("path", path).option("compression", "zstd")
     .bucketBy(buckets, *key).sortBy(*sort).saveAsTable(name))


def open_bucketed(spark: SparkSession, path: str, key: Sequence[str], sort: Sequence[str], buckets: int) -> DataFrame:
    """The table below ``path`` with its bucketing known to the planner, in this session's catalogue (which holds
    nothing but the layout: the table is its files)."""
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({', '.join(key)}) "
                  f"SORTED BY ({', '.join(sort)}) INTO {buckets} BUCKETS LOCATION '{_quoted(path)}'")
    return spark.table(name)


def write_by_prefix(df: DataFrame, path: str, key: str = "digest", levels: Sequence[int] = LEVELS, files: int | None = None) -> None:
    """Writes ``df`` in folders ``p0=AA/p1=BB``; rows are range-partitioned by the key, so a task writes neighbouring
    folders and sorted files."""
    at, cols = 1, {}
    for i, n in enumerate(levels):
        cols[f"p{i}"] = F.substring(key, at, n)
        at += n
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    (df.withColumns(cols).repartitionByRange(n, key).sortWithinPartitions(key)
     .write.mode("overwrite").partitionBy(*cols).parquet(path))


def prefix_filter(prefix: str, key: str = "digest", levels: Sequence[int] = LEVELS) -> Column:
    """Predicate of a prefix on the folder columns and the key."""
    cond, rest = F.lit(True), prefix
    for i, n in enumerate(levels):
        if not rest:
            return cond
        part, rest = rest[:n], rest[n:]
        cond = cond & (F.col(f"p{i}") == part if len(part) == n else F.col(f"p{i}").startswith(part))
    return cond & F.col(key).startswith(prefix) if rest else cond


def read_by_prefix(spark: SparkSession, path: str, prefix: str = "", key: str = "digest", levels: Sequence[int] = LEVELS) -> DataFrame:
    """Rows whose key begins with ``prefix`` (all of them for an empty one)."""
    cols = [f"p{i}" for i in range(len(levels))]
    rows = spark.read.option("basePath", path).schema(_schema(spark, path, cols)).parquet(path)
    return rows.where(prefix_filter(prefix, key, levels)).drop(*cols)


def _schema(spark: SparkSession, path: str, cols: list[str]):
    """The table's schema with folder columns as text (a folder named '23' is not a number)."""
    from pyspark.sql import types as T
    found = spark.read.parquet(path).schema
    return T.StructType([T.StructField(f.name, T.StringType() if f.name in cols else f.dataType) for f in found])
