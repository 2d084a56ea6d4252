"""First-row-per-key selections (W2, E4, E5, E8) as aggregates, not windows.

``min(struct(order keys..., payload...))`` is a partial/final aggregate: each task keeps one candidate per key
before the shuffle, so a key holding a third of all rows costs one row of shuffle per task instead of one giant
sorted window partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
             payload: Sequence[str] | None = None) -> DataFrame:
    """For each key keep the row that is smallest by ``order`` (ascending; give a total order)."""
    keys = list(keys)
    payload = [c for c in (payload or df.columns) if c not in keys]
    order_fields = [(F.col(o) if isinstance(o, str) else o).alias(f"__o{i}") for i, o in enumerate(order)]
    best = F.min(F.struct(*order_fields, *[F.col(c) for c in payload])).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("__best")[c].alias(c) for c in payload])


def capture_dedup(crawl: DataFrame, order: Sequence[str] = ("crawl_ts", "page", "capture_id")) -> DataFrame:
    """First-wins de-duplication of captures on (surt, captured_at) in crawl order."""
    return first_by(crawl, ["surt", "captured_at"], list(order))
