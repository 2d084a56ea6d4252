"""Content digests: base32 text of SHA-1, validity classes and store paths, all as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC 4648 base32 alphabet; a valid digest is 32 symbols of it (20 bytes).
BASE32_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CONV32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
VALID_DIGEST_PATTERN = "^[A-Z2-7]{32}$"
STORE_SUFFIX = ".zst"
STORE_PATH_PATTERN = r"/[A-Z2-7]{2}/[A-Z2-7]{2}/[A-Z2-7]{32}\.zst$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hex40_to_base32(h) -> Column:
    """40 hex digits -> 32 base32 symbols. Every 5 hex digits (20 bits) are 4 base-32 digits: ``conv`` to base 32
    (digits 0-9A-V), left-pad to 4, then one ``translate`` maps that digit set onto the RFC 4648 alphabet."""
    h = _col(h)
    groups = [F.lpad(F.conv(F.substring(h, g * 5 + 1, 5), 16, 32), 4, "0") for g in range(8)]
    return F.translate(F.concat(*groups), CONV32_DIGITS, BASE32_ALPHABET)


def content_digest(body) -> Column:
    """base32(SHA-1(body)); strings are hashed as UTF-8 bytes."""
    return hex40_to_base32(F.sha1(_col(body)))


def digest_kind(s) -> Column:
    """B10: 'invalid' unless 32 bytes long (kept verbatim), 'valid' when all base32 symbols, else 'error'."""
    s = _col(s)
    return (F.when(s.isNull(), F.lit(None).cast("string"))
            .when(F.octet_length(s) != 32, F.lit("invalid"))
            .when(s.rlike(VALID_DIGEST_PATTERN), F.lit("valid"))
            .otherwise(F.lit("error")))


def is_valid_digest(s) -> Column:
    return _col(s).rlike(VALID_DIGEST_PATTERN)


def store_location(digest) -> Column:
    """B19: 'AA/BB/<digest>.zst' for a valid digest, else NULL."""
    d = _col(digest)
    return F.when(is_valid_digest(d), F.concat_ws("/", d.substr(1, 2), d.substr(3, 2), F.concat(d, F.lit(STORE_SUFFIX))))


def store_path_valid(path) -> Column:
    """Two 2-symbol folders and a 32-symbol stem with the store suffix (folders need not match the stem)."""
    return _col(path).rlike(STORE_PATH_PATTERN)


def digest_from_store_path(path) -> Column:
    """Stem of a store path (first 32 characters of the file name)."""
    return F.substring(F.substring_index(_col(path), "/", -1), 1, 32)
