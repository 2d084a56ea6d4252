"""Archive URLs, canned redirect bodies, pattern queries, CDX field casts and other small scalar helpers."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.surt import surt_canonical_url, surt_from_url
from tidemark.functions.timefmt import ts14_format, ts14_parse

# Archive replay address, replay-URL pattern (http or https, optional 'id_' flag), the canned body
# the archive stores for a 302 capture, redirect file names and the 32 redirect file prefixes.
ARCHIVE_PREFIX = "web.archive.org/web/"
ARCHIVE_URL_PATTERN = r"(?s)^https?://web\.archive\.org/web/([0-9]{14})(?:id_)?/(.+)$"
REDIRECT_HTML_HEAD = '<html><body>You are being <a href="'
REDIRECT_HTML_TAIL = '">redirected</a>.</body></html>'
REDIRECT_HTML_PATTERN = r'^<html><body>You are being <a href="([^"]+)">redirected</a>\.</body></html>$'
REDIRECT_FILE_PATTERN = r"redirects-[2-7A-Z][.]csv$"
REDIRECT_FILE_PREFIXES = "234567ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def archive_url(url, ts, https: bool = True, original: bool = False) -> Column:
    """Replay URL http[s]://web.archive.org/web/<ts14>[id_]/<url>."""
    return F.concat(F.lit("https://" if https else "http://"), F.lit(ARCHIVE_PREFIX), ts14_format(ts),
                    F.lit("id_" if original else ""), F.lit("/"), _col(url))


def archive_url_parse(s) -> Column:
    """Replay URL -> struct(url, ts); NULL when it is not one (dots escaped, 'http:s' rejected: D14)."""
    s = _col(s)
    ts = ts14_parse(F.regexp_extract(s, ARCHIVE_URL_PATTERN, 1))
    return F.when(s.rlike(ARCHIVE_URL_PATTERN) & ts.isNotNull(),
                  F.struct(F.regexp_extract(s, ARCHIVE_URL_PATTERN, 2).alias("url"), ts.alias("ts")))


def redirect_html(url) -> Column:
    """The body the archive stores for a redirect to ``url``."""
    return F.concat(F.lit(REDIRECT_HTML_HEAD), _col(url), F.lit(REDIRECT_HTML_TAIL))


def redirect_target(html) -> Column:
    """Inverse of B12 on the whole string; NULL when the body is not a canned redirect."""
    return F.nullif(F.regexp_extract(_col(html), REDIRECT_HTML_PATTERN, 1), F.lit(""))


def gravatar_hash(email) -> Column:
    """Hex md5 of the ASCII-lower-cased address (no trimming, non-ASCII letters untouched)."""
    return F.md5(F.translate(_col(email), string.ascii_uppercase, string.ascii_lowercase))


def pattern_from_query(query) -> Column:
    """B16: 'https://host/path*' -> struct(surt, prefix); trailing '*' marks a prefix pattern."""
    q = _col(query)
    is_prefix = q.endswith("*")
    body = F.when(is_prefix, q.substr(F.lit(1), F.length(q) - 1)).otherwise(q)
    return F.struct(surt_from_url(body).alias("surt"), is_prefix.alias("prefix"))


def pattern_query(surt, prefix) -> Column:
    """(surt, prefix) -> query string (canonical URL, '*' appended for prefix patterns)."""
    return F.concat(surt_canonical_url(surt), F.when(_col(prefix), F.lit("*")).otherwise(F.lit("")))


def status_code(s) -> Column:
    """CDX status text -> int; '-' -> NULL; non-numbers and values outside 0..65535 -> NULL (flagged by caller)."""
    s = _col(s)
    v = F.when(s.rlike(r"^\+?[0-9]+$"), s.try_cast("long"))
    return F.when((s != "-") & v.between(0, 65535), v.cast("int"))


def status_code_error(s) -> Column:
    """True when a status text is neither '-' nor a valid u16."""
    s = _col(s)
    return s.isNotNull() & (s != "-") & status_code(s).isNull()


def mime_type(s) -> Column:
    """Identity today (no validation)."""
    return _col(s)


def checked_long(s) -> Column:
    """Text -> bigint, NULL when not an unsigned number that fits (u64 values beyond i64 are rejected)."""
    s = _col(s)
    return F.when(s.rlike(r"^\+?[0-9]+$"), s.try_cast("long"))


def redirect_file_valid(path) -> Column:
    """File name redirects-<prefix>.csv with a base32 prefix."""
    return F.substring_index(_col(path), "/", -1).rlike("^" + REDIRECT_FILE_PATTERN)


def status_url_parts(url) -> Column:
    """Status-page URL -> struct(screen_name, status_id decimal(20,0)); NULL when it is not one."""
    pat = r"^https?://(?:www\.|mobile\.)?twitter\.com/([^/?#]+)/status(?:es)?/([0-9]+)"
    u = _col(url)
    return F.when(u.rlike(pat), F.struct(F.regexp_extract(u, pat, 1).alias("screen_name"),
                                         F.regexp_extract(u, pat, 2).try_cast("decimal(20,0)").alias("status_id")))



# Parts of a URL reference (RFC 3986, appendix B, with the marks kept so that an empty part differs from none):
# 1 scheme, 2 authority with its slashes, 3 path, 4 query with its mark, 5 fragment with its mark.
REFERENCE_PATTERN = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)([?][^#]*)?(#.*)?$"
_SEP = "\u0001"


def _reference_parts(ref: Column) -> Column:
    """[scheme, authority, path, query, fragment] in one regex pass; every string is some reference."""
    marked = "$1" + "".join(f"{_SEP}${i}" for i in range(2, 6))
    return F.split(F.regexp_replace(F.replace(ref, F.lit(_SEP), F.lit("")), REFERENCE_PATTERN, marked), _SEP, -1)


def remove_dot_segments(path) -> Column:
    """RFC 3986 section 5.2.4 as a fold over the segments: '.' is dropped, '..' takes its predecessor along (never the
    root), and a path that ends in either ends in a slash."""
    segments = F.split(_col(path), "/", -1)
    dots = F.array(F.lit("."), F.lit(".."))

    def step(acc, s):
        pop = (F.size(acc) > 1) | ((F.size(acc) == 1) & (F.get(acc, F.lit(0)) != ""))
        return (F.when(s == ".", acc)
                .when(s == "..", F.when(pop, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
                .otherwise(F.concat(acc, F.array(s))))

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    ends = F.array_contains(dots, F.element_at(segments, -1))
    return F.array_join(F.when(ends, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def resolve_reference(base, ref) -> Column:
    """RFC 3986 section 5.2: the URL that ``ref`` means on a page at ``base``; NULL when neither has a scheme."""
    def resolved(b, r):
        path, from_ref = r[2], (r[0] != "") | (r[1] != "")
        # merge: the base's folder, or the root where the base has an authority and no path
        folder = F.when((b[1] != "") & (b[2] == ""), "/").otherwise(F.regexp_extract(b[2], "^(.*/)?", 0))
        scheme = F.when(r[0] != "", r[0]).otherwise(b[0])
        host = F.when(from_ref, r[1]).otherwise(b[1])
        target = F.when(from_ref | path.startswith("/"), path).otherwise(F.concat(folder, path))
        new_path = F.when(~from_ref & (path == ""), b[2]).otherwise(_let(target, remove_dot_segments))
        query = F.when(from_ref | (path != "") | (r[3] != ""), r[3]).otherwise(b[3])
        return F.when(scheme != "", F.concat(scheme, F.lit(":"), host, new_path, query, r[4]))

    def fields(x):
        return [F.get(x, F.lit(i)) for i in range(5)]

    def with_base(r):
        return _let(_reference_parts(F.coalesce(_col(base), F.lit(""))), lambda b: resolved(fields(b), fields(r)))

    return F.when(_col(ref).isNotNull(), _let(_reference_parts(_col(ref)), with_base))


def page_link(base, href) -> Column:
    """``href`` as an http(s) link of a page at ``base``: as it is written where it begins with 'http', else
    resolved; NULL for empty ones, fragments of the page, and other schemes."""
    h = _col(href)
    full = _let(resolve_reference(base, h), lambda u: F.when(F.lower(F.substring(u, 1, 8)).rlike("^https?://"), u))
    return F.when(h.startswith("http"), h).when((h != "") & ~h.startswith("#"), full)
