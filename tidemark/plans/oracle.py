"""Independent DuckDB SQL for the correctness gate.

The derived relations of ``fixtures.py`` are re-stated here as CTEs in DuckDB's dialect (same recipe, written
separately), so every query's oracle is one self-contained SQL string over the driver's pre-registered views.
"""

from __future__ import annotations

# Fixed values of the formats, stated here apart from the engine: a wrong one there must not be wrong on both sides.
BASE32_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
URL_PATTERN = r"(?s)^(https?)://(?:[^/?#@]*@)?([^/?#:@]*)(?::([0-9]*))?(/[^?#]*)?(?:[?#].*)?$"
NUMERIC_HOST_PATTERN = r"(^|[.])(0x[0-9a-f]*|[0-9]+)[.]?$"
TOKEN_PATTERN = r"([\p{L}\p{N}]+)"
MAX_TOKEN_BYTES = 40
REDIRECT_HTML_HEAD = '<html><body>You are being <a href="'
REDIRECT_HTML_TAIL = '">redirected</a>.</body></html>'


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def d_digest(x: str) -> str:
    """base32(sha1(x)) in DuckDB."""
    return (f"array_to_string(list_transform(range(0, 32), lambda k: substr({q(BASE32_ALPHABET)}, "
            f"((('0x' || substr(sha1({x}), (k // 4) * 5 + 1, 5))::INTEGER >> ((3 - (k % 4)) * 5)) & 31) + 1, 1)), '')")


def d_surt(u: str) -> str:
    lu = f"lower({u})"
    P = q(URL_PATTERN)
    scheme, host, port, path = (f"regexp_extract({lu}, {P}, {i})" for i in (1, 2, 3, 4))
    return (f"CASE WHEN regexp_full_match({lu}, {P}) AND {host} <> '' AND NOT regexp_matches({host}, "
            f"{q(NUMERIC_HOST_PATTERN)}) AND ({port} = '' OR ({scheme} = 'http' AND {port} = '80') OR "
            f"({scheme} = 'https' AND {port} = '443')) THEN array_to_string(list_reverse(string_split({host}, '.')), ',')"
            f" || ')' || CASE WHEN {path} = '' THEN '/' ELSE {path} END END")


def d_redirect_html(u: str) -> str:
    return f"({q(REDIRECT_HTML_HEAD)} || {u} || {q(REDIRECT_HTML_TAIL)})"


REFERENCE_PATTERN = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)([?][^#]*)?(#.*)?$"


def d_dots(path: str) -> str:
    """RFC 3986 section 5.2.4."""
    segs = f"string_split({path}, '/')"
    kept = (f"list_reduce(list_prepend([]::VARCHAR[], list_transform({segs}, lambda s: [s])), lambda a, s: CASE WHEN s[1] = '.' THEN a "
            f"WHEN s[1] = '..' THEN CASE WHEN len(a) > 1 OR (len(a) = 1 AND a[1] <> '') THEN a[:len(a) - 1] ELSE a END ELSE list_concat(a, s) END)")
    return f"array_to_string(list_concat({kept}, CASE WHEN {segs}[-1] IN ('.', '..') THEN [''] ELSE []::VARCHAR[] END), '/')"


def d_resolve(base: str, ref: str) -> str:
    """RFC 3986 section 5.2: ``ref`` on a page at ``base``."""
    def part(x, i):
        return f"regexp_extract({x}, {q(REFERENCE_PATTERN)}, {i})"

    folder = f"CASE WHEN {part(base, 2)} <> '' AND {part(base, 3)} = '' THEN '/' ELSE regexp_extract({part(base, 3)}, '^(.*/)?', 0) END"
    return (f"CASE WHEN {part(ref, 1)} <> '' THEN {part(ref, 1)} || ':' || {part(ref, 2)} || {d_dots(part(ref, 3))} || {part(ref, 4)} "
            f"ELSE {part(base, 1)} || ':' || CASE WHEN {part(ref, 2)} <> '' THEN {part(ref, 2)} || {d_dots(part(ref, 3))} || {part(ref, 4)} "
            f"ELSE {part(base, 2)} || CASE WHEN {part(ref, 3)} = '' THEN {part(base, 3)} || CASE WHEN {part(ref, 4)} <> '' THEN {part(ref, 4)} ELSE {part(base, 4)} END "
            f"WHEN starts_with({part(ref, 3)}, '/') THEN {d_dots(part(ref, 3))} || {part(ref, 4)} "
            f"ELSE {d_dots('(' + folder + ' || ' + part(ref, 3) + ')')} || {part(ref, 4)} END END END || {part(ref, 5)}")


def d_escape(x: str) -> str:
    """& < > as character references."""
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def d_tokens(x: str) -> str:
    """Lower-cased tokens shorter than the byte limit, in order."""
    return (f"list_transform(list_filter(regexp_extract_all(coalesce({x}, ''), {q(TOKEN_PATTERN)}, 1), "
            f"lambda t: strlen(t) < {MAX_TOKEN_BYTES}), lambda t: lower(t))")


NDOCS = "(SELECT count(*) FROM documents)"

# name -> (dependencies, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "docd": ((), f"SELECT doc_id, {d_digest('text')} AS digest, n_chars, text FROM documents"),
    "captures": (("docd",), f"""
        SELECT e.capture_id, e.url, {d_surt('e.url')} AS surt, e.captured_at, e.doc_id, d.digest, e.mime_type,
               e.status_code, d.n_chars AS length, e.crawl_ts
        FROM (SELECT event_id AS capture_id,
                     'https://site' || CAST(user_id % 12 AS VARCHAR) || '.example.com/u/' || CAST(user_id AS VARCHAR)
                       || '/' || event_type AS url,
                     make_timestamp(CAST(year(ts) - user_id % 10 AS BIGINT), month(ts), day(ts), hour(ts), minute(ts),
                                    CAST(second(ts) AS DOUBLE)) AS captured_at,
                     event_id % {NDOCS} AS doc_id,
                     CASE WHEN event_type = 'error' THEN 'application/json' ELSE 'text/html' END AS mime_type,
                     CAST(CASE WHEN event_id % 10 = 0 THEN 404 WHEN event_id % 10 = 1 THEN 302
                               WHEN event_id % 10 = 2 THEN NULL ELSE 200 END AS INTEGER) AS status_code,
                     ts AS crawl_ts
              FROM events) e
        JOIN docd d ON d.doc_id = e.doc_id"""),
    "crawl": (("captures",), """
        SELECT capture_id, url, surt, captured_at, doc_id, digest, mime_type, status_code, length, crawl_ts, 0 AS page
        FROM captures
        UNION ALL
        SELECT capture_id, url, surt, captured_at, doc_id, digest, mime_type, CAST(404 AS INTEGER), length,
               crawl_ts + INTERVAL 1 DAY, 1 AS page
        FROM captures WHERE capture_id % 20 = 0"""),
    "success": (("captures", "docd"), f"""
        SELECT c.capture_id, c.surt, c.captured_at, d.digest AS snapshot, c.correct_digest, c.crawl_ts AS fetched_at
        FROM (SELECT *, capture_id % 17 <> 0 AS correct_digest,
                     CASE WHEN capture_id % 17 <> 0 THEN doc_id ELSE (doc_id + 1) % {NDOCS} END AS stored_doc
              FROM captures WHERE capture_id % 3 <> 0) c
        JOIN docd d ON d.doc_id = c.stored_doc"""),
    "store": (("docd", "success"), """
        SELECT digest, min(text) AS body, CAST(strlen(min(text)) AS BIGINT) AS length
        FROM docd WHERE digest IN (SELECT snapshot FROM success) GROUP BY digest"""),
    "pattern_keys": (("captures",), r"""
        SELECT DISTINCT CAST(regexp_extract(split_part(surt, ')', 1) || ')', 'site([0-9]+)\)$', 1) AS INTEGER) AS k
        FROM captures"""),
    "patterns": (("pattern_keys",), """
        SELECT 'com,example,site' || CAST(k AS VARCHAR) || ')/u/' AS surt, 'Site ' || CAST(k AS VARCHAR) AS name,
               'site' || CAST(k AS VARCHAR) AS slug, k + 1 AS sort_id, true AS prefix, true AS active
        FROM (SELECT k FROM pattern_keys WHERE k IS NOT NULL
              UNION ALL SELECT max(k) + 1 FROM pattern_keys WHERE k IS NOT NULL)"""),
    "pattern_entry": (("captures", "patterns"), """
        SELECT p.slug, p.sort_id, c.capture_id, c.surt, c.captured_at
        FROM captures c JOIN patterns p
          ON (p.prefix AND starts_with(c.surt, p.surt)) OR (NOT p.prefix AND c.surt = p.surt)"""),
    "redirects": (("captures",), f"""
        SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY src, id) AS BIGINT) AS line_no,
               digest || ',' || url AS line, digest, url
        FROM (SELECT src, id, url, digest, 'redirects-' || substr(digest, 1, 1) || '.csv' AS file
              FROM (SELECT 0 AS src, page_id AS id, url,
                           CASE WHEN page_id % 11 = 0 THEN {d_digest('html')}
                                ELSE {d_digest(d_redirect_html('url'))} END AS digest
                    FROM pages
                    UNION ALL
                    SELECT 1, capture_id, 'https://' || array_to_string(list_reverse(string_split(split_part(surt, ')', 1), ',')), '.')
                             || substr(surt, length(split_part(surt, ')', 1)) + 2), digest
                    FROM captures WHERE status_code = 302))"""),
    "digest_list": (("store",), f"""
        SELECT DISTINCT digest FROM (SELECT digest FROM store UNION ALL SELECT {d_digest('text')} FROM benchmark)"""),
    "snapshot_info": (("success", "captures", "pattern_entry", "patterns"), """
        SELECT s.snapshot, s.capture_id, s.surt, s.captured_at, pe.slug, p.sort_id
        FROM success s
        JOIN captures c ON c.capture_id = s.capture_id AND c.mime_type = 'text/html'
        JOIN pattern_entry pe ON pe.capture_id = s.capture_id
        JOIN patterns p ON p.slug = pe.slug AND p.active"""),
    "search_docs": (("snapshot_info", "store"), """
        SELECT r.snapshot, r.surt, r.captured_at, r.slug, CAST(year(r.captured_at) AS INTEGER) AS year,
               split_part(st.body, chr(10), 1) AS title, st.body AS content
        FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot ORDER BY captured_at, slug, surt) AS rn
                             FROM snapshot_info) WHERE rn = 1) r
        JOIN store st ON st.digest = r.snapshot"""),
    "doc_tokens": (("search_docs",), f"""
        SELECT snapshot, 'title' AS field, t.token, t.pos
        FROM search_docs, LATERAL (SELECT unnest(regexp_extract_all(coalesce(title, ''), {q(TOKEN_PATTERN)}, 1)) AS token,
                                          generate_subscripts(regexp_extract_all(coalesce(title, ''), {q(TOKEN_PATTERN)}, 1), 1) - 1 AS pos) t
        WHERE strlen(t.token) < {MAX_TOKEN_BYTES}
        UNION ALL
        SELECT snapshot, 'content' AS field, t.token, t.pos
        FROM search_docs, LATERAL (SELECT unnest(regexp_extract_all(coalesce(content, ''), {q(TOKEN_PATTERN)}, 1)) AS token,
                                          generate_subscripts(regexp_extract_all(coalesce(content, ''), {q(TOKEN_PATTERN)}, 1), 1) - 1 AS pos) t
        WHERE strlen(t.token) < {MAX_TOKEN_BYTES}"""),
    "postings": (("doc_tokens",), """
        SELECT snapshot, field, lower(token) AS token, pos FROM doc_tokens"""),
    "field_lengths": (("postings", "search_docs"), """
        SELECT d.snapshot, d.field, coalesce(n.dl, 0) AS dl
        FROM (SELECT snapshot, 'title' AS field FROM search_docs
              UNION ALL SELECT snapshot, 'content' AS field FROM search_docs) d
        LEFT JOIN (SELECT snapshot, field, count(*) AS dl FROM postings GROUP BY ALL) n
          ON n.snapshot = d.snapshot AND n.field = d.field"""),
    "field_stats": (("field_lengths",), """
        SELECT field, count(*) AS n_docs, avg(dl) AS avgdl FROM field_lengths GROUP BY field"""),
}


def with_ctes(body: str, *needs: str, extra: tuple[tuple[str, str], ...] = (),
              instead: dict[str, tuple[tuple[str, ...], str]] | None = None) -> str:
    """Prefix ``body`` with the CTEs it needs (transitively, dependencies first), then query-local ``extra``; ``instead``
    gives other definitions to some of them."""
    order: list[str] = []
    ctes = CTES | (instead or {})

    def visit(n: str) -> None:
        if n in order:
            return
        for d in ctes[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    items = [(n, ctes[n][1]) for n in order] + list(extra)
    if not items:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({b})" for n, b in items) + "\n" + body
