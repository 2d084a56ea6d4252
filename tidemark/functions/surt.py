"""SURT keys (sort-friendly URL keys such as ``com,twitter)/user``) as native Column expressions.

All functions return NULL where the URL or key is not acceptable, so bad rows can be routed to a reject table
instead of failing a job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-match pattern for an absolute http(s) URL after lower-casing:
#   1 scheme, 2 host, 3 port digits, 4 path (may be absent); user info, query and fragment are dropped.
URL_PATTERN = r"(?s)^(https?)://(?:[^/?#@]*@)?([^/?#:@]*)(?::([0-9]*))?(/[^?#]*)?(?:[?#].*)?$"
# A host whose last label is numeric is an IP address (or invalid), never a domain name.
NUMERIC_HOST_PATTERN = r"(^|[.])(0x[0-9a-f]*|[0-9]+)[.]?$"
# Text form of a SURT: lower-case labels of [a-z0-9-], comma separated, then ')' and a path starting with '/'.
SURT_HEAD_PATTERN = r"^[a-z0-9,-]*\)/"

_SEP = "\u0001"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _url_fields(url) -> Column:
    """One regex pass: array [scheme, host, port, path, ''] when the lower-cased URL matches, else a 1-element
    array. Always evaluated (no conditional), so every field access shares this one expression."""
    return F.split(F.regexp_replace(F.lower(_col(url)), URL_PATTERN, f"$1{_SEP}$2{_SEP}$3{_SEP}$4{_SEP}"), _SEP)


def url_parts(url) -> Column:
    """struct(scheme, host, port, path) of a lower-cased http(s) URL, NULL when it does not parse."""
    parts = _url_fields(url)
    return F.when(F.size(parts) == 5, F.struct(
        F.get(parts, 0).alias("scheme"), F.get(parts, 1).alias("host"),
        F.get(parts, 2).alias("port"), F.get(parts, 3).alias("path")))


def surt_from_url(url) -> Column:
    """B1: URL -> SURT text. Scheme http/https only; host must be a domain name; an explicit non-default port,
    an empty host or an IP host gives NULL. Labels are reversed, path kept (empty -> '/'), query/fragment dropped."""
    parts = _url_fields(url)
    scheme, host, port, path = (F.get(parts, i) for i in range(4))
    default_port = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    ok = (F.size(parts) == 5) & (host != "") & ~host.rlike(NUMERIC_HOST_PATTERN) & default_port
    domain = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.when(ok, F.concat(domain, F.lit(")"), F.when(path == "", F.lit("/")).otherwise(path)))


def surt_domain(surt) -> Column:
    """Label part of a SURT text (before the first ')')."""
    return F.substring_index(_col(surt), ")", 1)


def surt_path(surt) -> Column:
    """Path part of a SURT text (after the first ')')."""
    s = _col(surt)
    return s.substr(F.length(surt_domain(s)) + 2, F.lit(1 << 30))


def surt_parse(surt) -> Column:
    """B2: SURT text -> struct(domain array<string>, path string); NULL when not lower-case, a label has a
    character outside [a-z0-9-], there is no ')' or the path does not start with '/'."""
    s = _col(surt)
    ok = (s == F.lower(s)) & s.rlike(SURT_HEAD_PATTERN)
    return F.when(ok, F.struct(F.split(surt_domain(s), ",").alias("domain"), surt_path(s).alias("path")))


def surt_text(parsed) -> Column:
    """struct(domain, path) -> SURT text."""
    p = _col(parsed)
    return F.concat(F.array_join(p["domain"], ","), F.lit(")"), p["path"])


def surt_canonical_url(surt) -> Column:
    """SURT text -> https URL with the labels back in host order."""
    s = _col(surt)
    host = F.array_join(F.reverse(F.split(surt_domain(s), ",")), ".")
    return F.when(s.rlike(SURT_HEAD_PATTERN), F.concat(F.lit("https://"), host, surt_path(s)))


def surt_host_key(surt) -> Column:
    """Domain part including the closing ')' (equi-join key for prefix patterns that contain the ')')."""
    return F.concat(surt_domain(_col(surt)), F.lit(")"))
