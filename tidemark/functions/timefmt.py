"""Archive timestamps: 14-digit UTC text, epoch seconds, date parameters (session time zone must be UTC)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: 14-digit archive timestamp layout (year month day hour minute second, UTC).
TS14_PATTERN = "yyyyMMddHHmmss"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts14_parse(s) -> Column:
    """Exactly 14 bytes in yyyyMMddHHmmss -> timestamp; anything else -> NULL."""
    s = _col(s)
    return F.when((F.octet_length(s) == 14) & s.rlike("^[0-9]{14}$"), F.try_to_timestamp(s, F.lit(TS14_PATTERN)))


def ts14_format(ts) -> Column:
    """Timestamp -> 14-digit text."""
    return F.date_format(_col(ts), TS14_PATTERN)


def from_epoch_seconds(s) -> Column:
    """Epoch seconds -> timestamp."""
    return F.timestamp_seconds(_col(s))


def to_epoch_seconds(ts) -> Column:
    """Timestamp -> epoch seconds (bigint)."""
    return F.unix_timestamp(_col(ts)).cast("bigint")


def date_param(s) -> Column:
    """B25: 'YYYY-MM-DD' -> midnight UTC timestamp (NULL when malformed)."""
    return F.try_to_timestamp(_col(s), F.lit("yyyy-MM-dd"))


def capture_year(ts) -> Column:
    """Facet year of a capture."""
    return F.year(_col(ts))


def utc_bound(value) -> Column:
    """A bound as a timestamp; a naive datetime is UTC, whatever the driver's time zone."""
    if not isinstance(value, dt.datetime):
        return F.lit(value)
    aware = value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
    return F.timestamp_micros(F.lit((aware - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)))


def half_open(col, start=None, end=None) -> Column | None:
    """Predicate start <= col < end; a missing bound adds no predicate (D16); no bounds -> None."""
    c = _col(col)
    pred = None
    if start is not None:
        pred = c >= utc_bound(start)
    if end is not None:
        p2 = c < utc_bound(end)
        pred = p2 if pred is None else (pred & p2)
    return pred
