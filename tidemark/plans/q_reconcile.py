"""Catalogue part 2: collections, missing bodies, wrong digests, discovery and digest set differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import patterns as pat
from tidemark.operators import reconcile as rc
from tidemark.functions import content_digest
from tidemark.operators import upsert
from tidemark.plans import fixtures as fx
from tidemark.plans.catalog import register
from tidemark.plans.oracle import d_digest, with_ctes


def _redirect_digests(spark, sf):
    return fx.redirects(spark, sf).select("digest")


def _cdx_digests(spark, sf):
    return fx.captures(spark, sf).select("digest")


# ---------------------------------------------------------------- collections
@register("pattern_list", with_ctes("SELECT sort_id, slug, name, surt, prefix FROM patterns", "patterns"))
def pattern_list(spark, sf):
    return pat.pattern_list(fx.patterns(spark, sf)).select("sort_id", "slug", "name", "surt", "prefix")


@register("pattern_assign_prefix", with_ctes("SELECT slug, capture_id, surt, captured_at FROM pattern_entry",
                                             "pattern_entry"))
def pattern_assign_prefix(spark, sf):
    return fx.pattern_entry.build(spark, sf).select("slug", "capture_id", "surt", "captured_at")


@register("pattern_stats", with_ctes("""
    SELECT p.sort_id, p.slug, p.name, p.surt, p.prefix, CAST(count(DISTINCT s.capture_id) AS BIGINT) AS indexed
    FROM patterns p LEFT JOIN pattern_entry pe ON pe.slug = p.slug
    LEFT JOIN success s ON s.capture_id = pe.capture_id
    GROUP BY ALL""", "patterns", "pattern_entry", "success"))
def pattern_stats(spark, sf):
    return pat.pattern_stats(fx.patterns(spark, sf), fx.pattern_entry(spark, sf), fx.success(spark, sf))


@register("pattern_entry_upsert", with_ctes("""
    SELECT DISTINCT slug, capture_id FROM pattern_entry
    WHERE (slug, capture_id) NOT IN (SELECT (slug, capture_id) FROM pattern_entry WHERE captured_at < TIMESTAMP '2020-01-01')
    """, "pattern_entry"))
def pattern_entry_upsert(spark, sf):
    pe = fx.pattern_entry(spark, sf)
    old = pe.where(F.col("captured_at") < F.lit("2020-01-01").cast("timestamp"))
    return upsert.insert_pattern_entry(old.select("slug", "capture_id"), pe.select("slug", "capture_id"))


# ---------------------------------------------------------------- J1 / E4 / K3: what to fetch next
_MISSING_SQL = """
    SELECT c.* FROM captures c
    WHERE c.mime_type = 'text/html' AND (c.status_code IS NULL OR c.status_code = 200)
      AND NOT EXISTS (SELECT 1 FROM success s WHERE s.surt = c.surt AND s.captured_at = c.captured_at)"""


@register("missing_captures", with_ctes(
    "SELECT capture_id, surt, captured_at, url, digest, status_code, length FROM (" + _MISSING_SQL + ")",
    "captures", "success"))
def missing_captures(spark, sf):
    m = rc.missing_captures(fx.captures(spark, sf), fx.success(spark, sf))
    return m.select("capture_id", "surt", "captured_at", "url", "digest", "status_code", "length")


@register("missing_captures_limit", with_ctes(
    "SELECT capture_id, surt, captured_at, url, digest FROM (" + _MISSING_SQL + ") ORDER BY surt, captured_at LIMIT 100",
    "captures", "success"))
def missing_captures_limit(spark, sf):
    m = rc.missing_captures(fx.captures(spark, sf), fx.success(spark, sf), limit=100)
    return m.select("capture_id", "surt", "captured_at", "url", "digest")


@register("missing_best_per_digest", with_ctes("""
    SELECT url, captured_at, digest FROM (
      SELECT *, row_number() OVER (PARTITION BY digest ORDER BY strlen(url), captured_at, url) AS rn
      FROM (""" + _MISSING_SQL + """)) WHERE rn = 1""", "captures", "success"))
def missing_best_per_digest(spark, sf):
    m = rc.missing_captures(fx.captures(spark, sf), fx.success(spark, sf))
    return rc.missing_best_per_digest(m)


# ---------------------------------------------------------------- J2 / E5
@register("snapshot_info", with_ctes("SELECT snapshot, capture_id, surt, captured_at, slug, sort_id FROM snapshot_info",
                                     "snapshot_info"))
def snapshot_info(spark, sf):
    return fx.index_sources(spark, sf)


@register("snapshot_representative", with_ctes("""
    SELECT snapshot, surt, captured_at, slug, capture_id FROM (
      SELECT *, row_number() OVER (PARTITION BY snapshot ORDER BY captured_at, slug, surt) AS rn FROM snapshot_info)
    WHERE rn = 1""", "snapshot_info"))
def snapshot_representative(spark, sf):
    return rc.representative(fx.index_sources(spark, sf)).select("snapshot", "surt", "captured_at", "slug", "capture_id")


# ---------------------------------------------------------------- J5 / J7 / J8: wrong digests and discovery
_INVALID_SQL = """
    SELECT c.url, c.captured_at, c.digest AS expected, s.snapshot AS actual
    FROM success s JOIN captures c ON c.capture_id = s.capture_id WHERE NOT s.correct_digest"""


@register("invalid_digests", with_ctes(_INVALID_SQL, "success", "captures"))
def invalid_digests(spark, sf):
    return rc.invalid_digests(fx.captures(spark, sf), fx.success(spark, sf))


@register("local_discovery", with_ctes("""
    SELECT capture_id, surt, captured_at, digest AS snapshot, true AS correct_digest FROM (""" + _MISSING_SQL + """)
    WHERE digest IN (SELECT digest FROM store)""", "captures", "success", "store"))
def local_discovery(spark, sf):
    m = rc.missing_captures(fx.captures(spark, sf), fx.success(spark, sf))
    return rc.local_discovery(m, fx.store(spark, sf))


_STORE_2020 = "(SELECT DISTINCT snapshot AS digest FROM success WHERE captured_at < TIMESTAMP '2020-01-01')"


@register("invalid_reconcile", with_ctes(f"""
    SELECT DISTINCT c.capture_id, c.surt, c.captured_at, p.actual AS snapshot, false AS correct_digest
    FROM (SELECT DISTINCT expected, actual FROM ({_INVALID_SQL})) p
    JOIN captures c ON c.digest = p.expected
    WHERE p.expected NOT IN (SELECT digest FROM {_STORE_2020}) AND p.actual IN (SELECT digest FROM {_STORE_2020})""",
                                        "success", "captures"))
def invalid_reconcile(spark, sf):
    """J8 against the body store as it stood in 2020 (bodies fetched for captures before then)."""
    succ = fx.success(spark, sf)
    store_2020 = (succ.where(F.col("captured_at") < F.lit("2020-01-01").cast("timestamp"))
                  .select(F.col("snapshot").alias("digest")).distinct())
    inv = rc.invalid_digests(fx.captures(spark, sf), succ)
    return rc.invalid_reconcile(inv, store_2020, fx.captures(spark, sf))


# ---------------------------------------------------------------- J9 / E9 / J10 / J12 / J13: digest set work
@register("unknown_digests", with_ctes("""
    SELECT digest FROM digest_list
    WHERE digest NOT IN (SELECT digest FROM captures) AND digest NOT IN (SELECT digest FROM redirects)""",
                                       "digest_list", "captures", "redirects"))
def unknown_digests(spark, sf):
    return rc.unknown_digests(fx.digest_list(spark, sf), _cdx_digests(spark, sf), _redirect_digests(spark, sf))


@register("unknown_digest_counts", with_ctes("""
    SELECT count(*) AS listed,
           count(*) FILTER (WHERE digest IN (SELECT digest FROM captures)) AS found,
           (SELECT count(*) FROM captures) AS known,
           count(*) FILTER (WHERE digest NOT IN (SELECT digest FROM captures)
                              AND digest IN (SELECT digest FROM redirects)) AS redirect_found,
           count(*) FILTER (WHERE digest NOT IN (SELECT digest FROM captures)
                              AND digest NOT IN (SELECT digest FROM redirects)) AS missing
    FROM digest_list""", "digest_list", "captures", "redirects"))
def unknown_digest_counts(spark, sf):
    return rc.unknown_digest_counts(fx.digest_list(spark, sf), _cdx_digests(spark, sf), _redirect_digests(spark, sf))


@register("import_candidates", with_ctes(f"""
    SELECT DISTINCT digest FROM (SELECT {d_digest('text')} AS digest FROM documents
                                 UNION ALL SELECT {d_digest('text')} FROM benchmark)
    WHERE digest NOT IN (SELECT digest FROM store) AND digest NOT IN (SELECT digest FROM redirects)""",
                                         "store", "redirects"))
def import_candidates(spark, sf):
    # the legacy store holds every document body and every benchmark text
    legacy = (fx.table(spark, sf, "documents").select("text")
              .unionByName(fx.table(spark, sf, "benchmark").select("text"))
              .select(content_digest("text").alias("digest")))
    return rc.import_candidates(legacy, fx.store(spark, sf), _redirect_digests(spark, sf)).distinct()


@register("captures_by_digest", with_ctes("""
    SELECT capture_id, surt, captured_at, digest FROM captures
    WHERE digest IN (SELECT expected FROM (""" + _INVALID_SQL + "))", "captures", "success"))
def captures_by_digest(spark, sf):
    wanted = rc.invalid_digests(fx.captures(spark, sf), fx.success(spark, sf)).select(F.col("expected").alias("digest"))
    return rc.captures_by_digest(fx.captures(spark, sf), wanted).select("capture_id", "surt", "captured_at", "digest")


@register("redirect_hops", with_ctes("""
    SELECT c.url, c.captured_at, c.digest, r.target FROM captures c
    JOIN (SELECT digest, max_by(url, (file, line_no)) AS target FROM redirects GROUP BY digest) r ON r.digest = c.digest
    WHERE c.status_code = 302""", "captures", "redirects"))
def redirect_hops(spark, sf):
    return rc.redirect_hops(fx.captures(spark, sf), fx.redirects(spark, sf))


@register("capture_date_range", with_ctes("""
    SELECT capture_id, surt, captured_at FROM captures
    WHERE captured_at >= CAST(DATE '2018-01-01' AS TIMESTAMP) AND captured_at < CAST(DATE '2019-07-01' AS TIMESTAMP)""",
                                          "captures"))
def capture_date_range(spark, sf):
    """Captures in a half-open range given as 'YYYY-MM-DD' request parameters (pushed to the scan)."""
    from tidemark.functions import date_param, half_open
    c = fx.captures(spark, sf)
    # request parameters stay expressions: constant-folded by the optimizer, then pushed to the scan
    start, end = date_param(F.lit("2018-01-01")), date_param(F.lit("2019-07-01"))
    return c.where(half_open("captured_at", start, end)).select("capture_id", "surt", "captured_at")


@register("capture_date_open_end", with_ctes("""
    SELECT capture_id, surt, captured_at FROM captures WHERE captured_at >= CAST(DATE '2023-01-01' AS TIMESTAMP)""",
                                             "captures"))
def capture_date_open_end(spark, sf):
    """A range with only a start adds only that predicate (no sentinel for the missing end)."""
    from tidemark.functions import half_open
    import datetime as dt
    c = fx.captures(spark, sf)
    return c.where(half_open("captured_at", dt.datetime(2023, 1, 1), None)).select("capture_id", "surt", "captured_at")
