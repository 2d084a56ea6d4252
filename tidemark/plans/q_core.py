"""Catalogue part 1: scalar functions over the driver tables, capture de-duplication and set-based upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import functions as tf
from tidemark.operators import dedup, upsert
from tidemark.plans import fixtures as fx
from tidemark.plans.catalog import register
from tidemark.plans.oracle import d_digest, d_redirect_html, d_surt, q, with_ctes

# Fixed values of the formats, stated here again for the DuckDB side.
ARCHIVE_URL_PATTERN = r"(?s)^https?://web\.archive\.org/web/([0-9]{14})(?:id_)?/(.+)$"
REDIRECT_HTML_PATTERN = r'^<html><body>You are being <a href="([^"]+)">redirected</a>\.</body></html>$'
STORE_PATH_PATTERN = r"/[A-Z2-7]{2}/[A-Z2-7]{2}/[A-Z2-7]{32}\.zst$"


# ---------------------------------------------------------------- B1-B4: SURT keys over page URLs
@register("surt_from_url", "SELECT page_id, url, " + d_surt("url") + " AS surt FROM pages")
def surt_from_url(spark, sf):
    p = fx.table(spark, sf, "pages")
    return p.select("page_id", "url", tf.surt_from_url("url").alias("surt"))


_CANON_SQL = with_ctes("""
    SELECT page_id, surt, 'https://' || array_to_string(list_reverse(string_split(split_part(surt, ')', 1), ',')), '.')
             || substr(surt, length(split_part(surt, ')', 1)) + 2) AS canonical_url
    FROM (SELECT page_id, """ + d_surt("url") + """ AS surt FROM pages) WHERE surt IS NOT NULL""")


@register("surt_canonical_url", _CANON_SQL)
def surt_canonical_url(spark, sf):
    p = fx.table(spark, sf, "pages").select("page_id", tf.surt_from_url("url").alias("surt")).where("surt IS NOT NULL")
    return p.select("page_id", "surt", tf.surt_canonical_url("surt").alias("canonical_url"))


@register("surt_parse", """
    SELECT page_id, surt, len(string_split(split_part(surt, ')', 1), ',')) AS n_labels,
           substr(surt, length(split_part(surt, ')', 1)) + 2) AS path,
           array_to_string(string_split(split_part(surt, ')', 1), ','), ',') || ')'
             || substr(surt, length(split_part(surt, ')', 1)) + 2) AS reprinted
    FROM (SELECT page_id, """ + d_surt("url") + """ AS surt FROM pages)
    WHERE surt = lower(surt) AND regexp_matches(surt, '^[a-z0-9,-]*\\)/')""")
def surt_parse(spark, sf):
    p = fx.table(spark, sf, "pages").select("page_id", tf.surt_from_url("url").alias("surt"))
    parsed = p.withColumn("parsed", tf.surt_parse("surt")).where("parsed IS NOT NULL")
    return parsed.select("page_id", "surt", F.size("parsed.domain").alias("n_labels"),
                         F.col("parsed.path").alias("path"), tf.surt_text("parsed").alias("reprinted"))


# ---------------------------------------------------------------- B5-B7, B18: timestamps over events
@register("ts14_roundtrip", """
    SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS ts14,
           try_strptime(strftime(ts, '%Y%m%d%H%M%S'), '%Y%m%d%H%M%S') AS parsed,
           CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS epoch_s,
           make_timestamp(CAST(epoch(date_trunc('second', ts)) AS BIGINT) * 1000000) AS from_epoch,
           CAST(year(ts) AS INTEGER) AS year
    FROM events""")
def ts14_roundtrip(spark, sf):
    e = fx.table(spark, sf, "events")
    return e.select("event_id", tf.ts14_format("ts").alias("ts14"), tf.ts14_parse(tf.ts14_format("ts")).alias("parsed"),
                    tf.to_epoch_seconds("ts").alias("epoch_s"),
                    tf.from_epoch_seconds(tf.to_epoch_seconds("ts")).alias("from_epoch"),
                    tf.capture_year("ts").alias("year"))


# ---------------------------------------------------------------- B8/B9: archive replay URLs of captures
@register("archive_url_roundtrip", with_ctes("""
    SELECT capture_id, wb, regexp_extract(wb, '""" + ARCHIVE_URL_PATTERN + """', 2) AS url_back,
           strptime(regexp_extract(wb, '""" + ARCHIVE_URL_PATTERN + """', 1), '%Y%m%d%H%M%S') AS ts_back
    FROM (SELECT capture_id, 'https://web.archive.org/web/' || strftime(captured_at, '%Y%m%d%H%M%S') || 'id_/' || url AS wb
          FROM captures)""", "captures"))
def archive_url_roundtrip(spark, sf):
    c = fx.captures(spark, sf).select("capture_id", tf.archive_url("url", "captured_at", original=True).alias("wb"))
    p = tf.archive_url_parse("wb")
    return c.select("capture_id", "wb", p["url"].alias("url_back"), p["ts"].alias("ts_back"))


# ---------------------------------------------------------------- B27: status-page URLs derived from events
@register("status_url", """
    SELECT event_id, CASE WHEN event_id % 4 < 3 THEN 'u' || CAST(user_id AS VARCHAR) END AS screen_name,
           CASE WHEN event_id % 4 < 3 THEN CAST(event_id AS VARCHAR) END AS status_id FROM events""")
def status_url(spark, sf):
    user, k = F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("event_id") % 4
    eid = F.col("event_id").cast("string")
    url = (F.when(k == 0, F.concat(F.lit("https://twitter.com/"), user, F.lit("/status/"), eid))
           .when(k == 1, F.concat(F.lit("https://mobile.twitter.com/"), user, F.lit("/statuses/"), eid, F.lit("?s=20")))
           .when(k == 2, F.concat(F.lit("http://www.twitter.com/"), user, F.lit("/status/"), eid, F.lit("/photo/1")))
           .otherwise(F.concat(F.lit("https://example.com/"), user, F.lit("/status/"), eid)))
    p = tf.status_url_parts(url)
    return fx.table(spark, sf, "events").select("event_id", p["screen_name"].alias("screen_name"),
                                                p["status_id"].cast("string").alias("status_id"))


# ---------------------------------------------------------------- B10/B11/B19: digests
@register("content_digest", "SELECT page_id, " + d_digest("html") + " AS digest FROM pages")
def content_digest(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", tf.content_digest("html").alias("digest"))


@register("digest_kind", f"""
    SELECT item, kind, count(*) AS n FROM (
      SELECT d AS item, CASE WHEN strlen(d) <> 32 THEN 'invalid' WHEN regexp_matches(d, '^[A-Z2-7]{{32}}$') THEN 'valid'
                              ELSE 'error' END AS kind
      FROM (SELECT {d_digest('text')} AS d FROM documents
            UNION ALL SELECT lower({d_digest('text')}) FROM documents
            UNION ALL SELECT substr({d_digest('text')}, 1, 31) FROM documents))
    GROUP BY item, kind""")
def digest_kind(spark, sf):
    d = fx.table(spark, sf, "documents").select(tf.content_digest("text").alias("d"))
    allv = d.unionByName(d.select(F.lower("d").alias("d"))).unionByName(d.select(F.substring("d", 1, 31).alias("d")))
    return (allv.select(F.col("d").alias("item"), tf.digest_kind("d").alias("kind"))
            .groupBy("item", "kind").agg(F.count(F.lit(1)).alias("n")))


@register("store_location", with_ctes("""
    SELECT digest, substr(digest, 1, 2) || '/' || substr(digest, 3, 2) || '/' || digest || '.zst' AS location,
           regexp_matches('/store/' || substr(digest, 1, 2) || '/' || substr(digest, 3, 2) || '/' || digest || '.zst',
                          '""" + STORE_PATH_PATTERN + """') AS path_ok
    FROM store""", "store"))
def store_location(spark, sf):
    s = fx.store(spark, sf).select("digest", tf.store_location("digest").alias("location"))
    return s.select("digest", "location", tf.store_path_valid(F.concat(F.lit("/store/"), "location")).alias("path_ok"))


# ---------------------------------------------------------------- B12/B13: canned redirect bodies
@register("redirect_roundtrip", f"""
    SELECT page_id, {d_redirect_html('url')} AS html,
           nullif(regexp_extract({d_redirect_html('url')}, '{REDIRECT_HTML_PATTERN}', 1), '') AS target,
           nullif(regexp_extract(html, '{REDIRECT_HTML_PATTERN}', 1), '') AS page_target
    FROM pages""")
def redirect_roundtrip(spark, sf):
    p = fx.table(spark, sf, "pages")
    return p.select("page_id", tf.redirect_html("url").alias("html"), tf.redirect_target(tf.redirect_html("url")).alias("target"),
                    tf.redirect_target("html").alias("page_target"))


# ---------------------------------------------------------------- B17: avatar hash of an address derived per page
@register("gravatar_hash", """
    SELECT page_id, md5(lower('Owner@' || split_part(split_part(url, '://', 2), '/', 1))) AS hash FROM pages""")
def gravatar_hash(spark, sf):
    p = fx.table(spark, sf, "pages")
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    return p.select("page_id", tf.gravatar_hash(F.concat(F.lit("Owner@"), host)).alias("hash"))


# ---------------------------------------------------------------- B16: collection query strings
@register("pattern_query", with_ctes("""
    SELECT slug, 'https://' || array_to_string(list_reverse(string_split(split_part(surt, ')', 1), ',')), '.')
             || substr(surt, length(split_part(surt, ')', 1)) + 2) || CASE WHEN prefix THEN '*' ELSE '' END AS query,
           surt AS surt_back, prefix AS prefix_back
    FROM patterns""", "patterns"))
def pattern_query(spark, sf):
    p = fx.patterns(spark, sf).select("slug", tf.pattern_query("surt", "prefix").alias("query"))
    back = tf.pattern_from_query("query")
    return p.select("slug", "query", back["surt"].alias("surt_back"), back["prefix"].alias("prefix_back"))


# ---------------------------------------------------------------- W2 / I2: first-wins capture de-duplication
@register("capture_dedup", with_ctes("""
    SELECT capture_id, surt, captured_at, status_code, crawl_ts, page FROM (
      SELECT *, row_number() OVER (PARTITION BY surt, captured_at ORDER BY crawl_ts, page, capture_id) AS rn FROM crawl)
    WHERE rn = 1""", "crawl"))
def capture_dedup(spark, sf):
    return dedup.capture_dedup(fx.crawl(spark, sf)).select(
        "capture_id", "surt", "captured_at", "status_code", "crawl_ts", "page")


# ---------------------------------------------------------------- I1-I10 set-based upserts
_OLD_SQL = "(SELECT * FROM crawl WHERE page = 0 AND captured_at < TIMESTAMP '2020-01-01')"


@register("surt_upsert", with_ctes(f"""
    SELECT DISTINCT surt FROM crawl WHERE surt NOT IN (SELECT surt FROM {_OLD_SQL})""", "crawl"))
def surt_upsert(spark, sf):
    cr = fx.crawl(spark, sf)
    old = cr.where((F.col("page") == 0) & (F.col("captured_at") < F.lit("2020-01-01").cast("timestamp")))
    return upsert.new_keys(cr.select("surt"), old.select("surt"), ["surt"])


@register("entry_upsert", with_ctes(f"""
    SELECT capture_id, surt, captured_at, status_code, page FROM (
      SELECT *, row_number() OVER (PARTITION BY surt, captured_at ORDER BY crawl_ts, page, capture_id) AS rn FROM crawl) n
    WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM {_OLD_SQL} o WHERE o.surt = n.surt AND o.captured_at = n.captured_at)""",
                                   "crawl"))
def entry_upsert(spark, sf):
    cr = fx.crawl(spark, sf)
    old = cr.where((F.col("page") == 0) & (F.col("captured_at") < F.lit("2020-01-01").cast("timestamp")))
    return upsert.insert_entries(old, cr).select("capture_id", "surt", "captured_at", "status_code", "page")


# ---------------------------------------------------------------- I4 (+I3): fetch results, discovered bodies added
_OLD_SUCCESS = "(SELECT * FROM success WHERE captured_at < TIMESTAMP '2020-01-01')"
_DISCOVERED = """(SELECT c.capture_id, c.digest AS snapshot, true AS correct_digest FROM captures c
    WHERE c.mime_type = 'text/html' AND (c.status_code IS NULL OR c.status_code = 200)
      AND NOT EXISTS (SELECT 1 FROM success s WHERE s.surt = c.surt AND s.captured_at = c.captured_at)
      AND c.digest IN (SELECT digest FROM store))"""


@register("success_upsert", with_ctes(f"""
    SELECT DISTINCT capture_id, snapshot, correct_digest FROM (
      SELECT capture_id, snapshot, correct_digest FROM success UNION ALL SELECT * FROM {_DISCOVERED}) b
    WHERE NOT EXISTS (SELECT 1 FROM {_OLD_SUCCESS} o WHERE o.capture_id = b.capture_id AND o.snapshot = b.snapshot
                      AND o.correct_digest = b.correct_digest)""", "success", "captures", "store"))
def success_upsert(spark, sf):
    from tidemark.operators import reconcile as rc
    succ = fx.success(spark, sf)
    old = succ.where(F.col("captured_at") < F.lit("2020-01-01").cast("timestamp"))
    found = rc.local_discovery(rc.missing_captures(fx.captures(spark, sf), succ), fx.store(spark, sf))
    batch = succ.select("capture_id", "snapshot", "correct_digest").unionByName(
        found.select("capture_id", "snapshot", "correct_digest"))
    rows, _ = upsert.insert_success(old, batch, fx.store(spark, sf))
    return rows.select("capture_id", "snapshot", "correct_digest")


@register("snapshot_upsert", with_ctes(f"""
    SELECT DISTINCT snapshot AS digest FROM (SELECT * FROM {_DISCOVERED})
    WHERE snapshot NOT IN (SELECT snapshot FROM {_OLD_SUCCESS})""", "success", "captures", "store"))
def snapshot_upsert(spark, sf):
    """Snapshot digests of a batch of discovered bodies that the snapshot table (as of 2020) lacks."""
    from tidemark.operators import reconcile as rc
    succ = fx.success(spark, sf)
    old = succ.where(F.col("captured_at") < F.lit("2020-01-01").cast("timestamp"))
    found = rc.local_discovery(rc.missing_captures(fx.captures(spark, sf), succ), fx.store(spark, sf))
    _, snaps = upsert.insert_success(old, found, old.select(F.col("snapshot").alias("digest")))
    return snaps


@register("failure_append", with_ctes("""
    SELECT capture_id, status_code, 'HTTP ' || CAST(status_code AS VARCHAR) AS error_message FROM captures
    WHERE status_code = 404""", "captures"))
def failure_append(spark, sf):
    """Failed fetches are appended (no key): earlier failures plus a new batch."""
    c = fx.captures(spark, sf).where(F.col("status_code") == 404).select(
        "capture_id", "status_code", F.concat(F.lit("HTTP "), F.col("status_code").cast("string")).alias("error_message"),
        "captured_at")
    cut = F.lit("2020-01-01").cast("timestamp")
    return upsert.append_failures(c.where(F.col("captured_at") < cut), c.where(F.col("captured_at") >= cut)).drop(
        "captured_at")


@register("pattern_upsert", with_ctes("""
    SELECT surt, prefix, slug, sort_id FROM patterns WHERE sort_id > 6""", "patterns"))
def pattern_upsert(spark, sf):
    """batch = every collection plus a clashing copy of each (same surt, sort_id + 100): the lowest sort_id wins
    inside the batch, and collections already stored (sort_id <= 6) are skipped."""
    p = fx.patterns(spark, sf).select("surt", "prefix", "slug", "sort_id")
    batch = p.unionByName(p.withColumn("sort_id", F.col("sort_id") + 100).withColumn("slug", F.concat("slug", F.lit("-copy"))))
    return upsert.insert_patterns(p.where(F.col("sort_id") <= 6), batch).select("surt", "prefix", "slug", "sort_id")


@register("pattern_updated", with_ctes("""
    SELECT p.slug, u.updated, u.updated IS NOT NULL AS touched FROM patterns p
    LEFT JOIN (SELECT slug, max(captured_at) AS updated FROM pattern_entry GROUP BY slug) u ON u.slug = p.slug""",
                                       "patterns", "pattern_entry"))
def pattern_updated(spark, sf):
    """Each collection's ``updated`` time set to its latest capture; collections without captures untouched."""
    upd = fx.pattern_entry(spark, sf).groupBy("slug").agg(F.max("captured_at").alias("updated"))
    return upsert.set_pattern_updated(fx.patterns(spark, sf).select("slug", "sort_id"), upd).select(
        "slug", "updated", "touched")
