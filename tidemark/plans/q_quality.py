"""Catalogue part 5: store validation, digest recomputation, incoming-file checks, redirect dataset checks,
redirect guesses and fetched-body checks (Q1-Q8, W1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import functions as tf
from tidemark.operators import quality as ql
from tidemark.operators.reconcile import missing_best_per_digest, missing_captures
from tidemark.plans import fixtures as fx
from tidemark.plans.catalog import register
from tidemark.plans.oracle import d_digest, d_redirect_html, with_ctes

# Fixed value of the store layout, stated here again for the DuckDB side.
STORE_PATH_PATTERN = r"/[A-Z2-7]{2}/[A-Z2-7]{2}/[A-Z2-7]{32}\.zst$"


def _loc(d: str) -> str:
    return f"(substr({d}, 1, 2) || '/' || substr({d}, 3, 2) || '/' || {d} || '.zst')"


_FILES_CTE = ("files", f"""
    SELECT 'store/' || {_loc('digest')} AS path, body FROM store
    UNION ALL SELECT 'store/' || {_loc(d_digest('url'))}, html FROM pages
    UNION ALL SELECT 'store/misc/' || CAST(item_id AS VARCHAR) || '.zst', text FROM benchmark""")


def _files(spark, sf):
    """Store files: every stored body under its digest, page bodies filed under the digest of their URL (wrong),
    benchmark texts under a path outside the layout."""
    st = fx.store(spark, sf).select(F.concat(F.lit("store/"), tf.store_location("digest")).alias("path"), "body")
    pg = fx.table(spark, sf, "pages").select(
        F.concat(F.lit("store/"), tf.store_location(tf.content_digest("url"))).alias("path"), F.col("html").alias("body"))
    bm = fx.table(spark, sf, "benchmark").select(
        F.concat(F.lit("store/misc/"), F.col("item_id").cast("string"), F.lit(".zst")).alias("path"),
        F.col("text").alias("body"))
    return st.unionByName(pg).unionByName(bm)


_STEM = "substr(regexp_extract(path, '[^/]*$'), 1, 32)"
_VALIDATE_SQL = f"""
    SELECT path, CASE WHEN regexp_matches(path, '{STORE_PATH_PATTERN}') THEN {_STEM} END AS expected,
           {d_digest('body')} AS actual,
           CASE WHEN NOT regexp_matches(path, '{STORE_PATH_PATTERN}') THEN 'unexpected_path'
                WHEN body IS NULL THEN 'io_error'
                WHEN {d_digest('body')} <> {_STEM} THEN 'invalid_digest' ELSE 'ok' END AS status
    FROM files"""


@register("store_validate", with_ctes(_VALIDATE_SQL, "store", extra=(_FILES_CTE,)))
def store_validate(spark, sf):
    return ql.validate_store(_files(spark, sf))


@register("store_invalid", with_ctes(f"SELECT * FROM ({_VALIDATE_SQL}) WHERE status IN ('invalid_digest', 'io_error')",
                                     "store", extra=(_FILES_CTE,)))
def store_invalid(spark, sf):
    return ql.invalid_files(ql.validate_store(_files(spark, sf)))


@register("digest_by_prefix", with_ctes(f"""
    SELECT {_STEM} AS expected, {d_digest('body')} AS actual FROM files WHERE starts_with({_STEM}, 'A')""",
                                        "store", extra=(_FILES_CTE,)))
def digest_by_prefix(spark, sf):
    return ql.digests_by_prefix(_files(spark, sf), "A")


@register("incoming_check", with_ctes(f"""
    SELECT name,
           CASE WHEN NOT regexp_matches(substr(name, 1, 32), '^[A-Z2-7]{{32}}$') OR strlen(substr(name, 1, 32)) <> 32 THEN 'error'
                WHEN substr(name, 1, 32) IN (SELECT digest FROM store) THEN 'stored'
                WHEN {d_digest('body')} = substr(name, 1, 32) THEN 'new' ELSE 'mismatch' END AS outcome,
           CASE WHEN substr(name, 1, 32) NOT IN (SELECT digest FROM store) AND {d_digest('body')} = substr(name, 1, 32)
                THEN {_loc('substr(name, 1, 32)')} END AS location,
           CASE WHEN substr(name, 1, 32) NOT IN (SELECT digest FROM store) AND {d_digest('body')} <> substr(name, 1, 32)
                THEN {d_digest('body')} END AS actual
    FROM (SELECT DISTINCT name, body FROM (
            SELECT {d_digest('text')} || '.zst' AS name, text AS body FROM documents
            UNION ALL SELECT {d_digest('url')} || '.zst', html FROM pages
            UNION ALL SELECT 'item-' || CAST(item_id AS VARCHAR) || '.zst', text FROM benchmark))""", "store"))
def incoming_check(spark, sf):
    d = fx.table(spark, sf, "documents").select(F.concat(tf.content_digest("text"), F.lit(".zst")).alias("name"),
                                                F.col("text").alias("body"))
    p = fx.table(spark, sf, "pages").select(F.concat(tf.content_digest("url"), F.lit(".zst")).alias("name"),
                                            F.col("html").alias("body"))
    b = fx.table(spark, sf, "benchmark").select(F.concat(F.lit("item-"), F.col("item_id").cast("string"),
                                                         F.lit(".zst")).alias("name"), F.col("text").alias("body"))
    incoming = d.unionByName(p).unionByName(b).distinct()
    return ql.check_incoming(incoming, fx.store(spark, sf))


# ---------------------------------------------------------------- redirect dataset
_LINE_OK = f"coalesce(url IS NOT NULL AND {d_digest(d_redirect_html('url'))} = digest, false)"


@register("redirect_validate", with_ctes(f"SELECT file, line_no, {_LINE_OK} AS line_ok FROM redirects", "redirects"))
def redirect_validate(spark, sf):
    return ql.validate_redirect_lines(fx.redirects(spark, sf)).select("file", "line_no", "line_ok")


@register("redirect_sorted", with_ctes("""
    SELECT a.file, a.line_no, b.line IS NULL OR a.line > b.line AS in_order
    FROM redirects a LEFT JOIN redirects b ON b.file = a.file AND b.line_no + 1 = a.line_no""", "redirects"))
def redirect_sorted(spark, sf):
    return ql.sortedness(fx.redirects(spark, sf)).select("file", "line_no", "in_order")


_PER_FILE_SQL = f"""
    SELECT a.file, regexp_matches(regexp_extract(a.file, '[^/]*$'), '^redirects-[2-7A-Z][.]csv$') AS name_ok,
           count(*) AS n_lines, count(*) FILTER (WHERE NOT a.line_ok) AS bad_lines,
           count(*) FILTER (WHERE NOT (b.line IS NULL OR a.line > b.line)) AS unsorted_lines,
           count(*) FILTER (WHERE NOT (b.line IS NULL OR a.line > b.line)) = 0 AS sorted
    FROM (SELECT *, {_LINE_OK} AS line_ok FROM redirects) a
    LEFT JOIN redirects b ON b.file = a.file AND b.line_no + 1 = a.line_no
    GROUP BY a.file"""


@register("redirect_files", with_ctes(_PER_FILE_SQL, "redirects"))
def redirect_files(spark, sf):
    return ql.validate_redirect_files(fx.redirects(spark, sf))


@register("redirect_verdict", with_ctes(f"""
    SELECT count(*) AS n_files, count(*) FILTER (WHERE NOT name_ok) AS bad_names,
           count(*) FILTER (WHERE NOT sorted) AS unsorted_files, CAST(sum(bad_lines) AS BIGINT) AS bad_lines,
           count(*) = 32 AND count(*) FILTER (WHERE NOT name_ok) = 0 AND count(*) FILTER (WHERE NOT sorted) = 0
             AND sum(bad_lines) = 0 AS valid
    FROM ({_PER_FILE_SQL})""", "redirects"))
def redirect_verdict(spark, sf):
    return ql.redirect_verdict(ql.validate_redirect_files(fx.redirects(spark, sf)))


@register("redirect_guess", with_ctes(f"""
    SELECT url, captured_at, digest, location, {d_digest(d_redirect_html('location'))} AS guessed,
           {d_digest(d_redirect_html('location'))} = digest AS match
    FROM (SELECT url, captured_at, digest,
                 'https://' || array_to_string(list_reverse(string_split(split_part(surt, ')', 1), ',')), '.')
                   || substr(surt, length(split_part(surt, ')', 1)) + 2) AS location
          FROM captures WHERE status_code = 302)""", "captures"))
def redirect_guess(spark, sf):
    c = fx.captures(spark, sf).where(F.col("status_code") == 302)
    return ql.redirect_guess(c.select("url", "captured_at", "digest", tf.surt_canonical_url("surt").alias("location")))


@register("fetched_check", with_ctes(f"""
    SELECT w.url, w.captured_at, w.digest AS expected, {d_digest('d.text')} AS actual,
           {d_digest('d.text')} = w.digest AS match, {_loc(d_digest('d.text'))} AS location
    FROM (SELECT url, captured_at, digest FROM (
            SELECT *, row_number() OVER (PARTITION BY digest ORDER BY strlen(url), captured_at, url) AS rn
            FROM captures c WHERE mime_type = 'text/html' AND (status_code IS NULL OR status_code = 200)
              AND NOT EXISTS (SELECT 1 FROM success s WHERE s.surt = c.surt AND s.captured_at = c.captured_at))
          WHERE rn = 1) w
    JOIN captures c ON c.url = w.url AND c.captured_at = w.captured_at
    JOIN docd d ON d.doc_id = CASE WHEN c.capture_id % 17 = 0 THEN (c.doc_id + 1) % (SELECT count(*) FROM documents)
                                   ELSE c.doc_id END""", "captures", "success", "docd"))
def fetched_check(spark, sf):
    caps = fx.captures(spark, sf)
    wanted = missing_best_per_digest(missing_captures(caps, fx.success(spark, sf)))
    n = fx.doc_count(spark, sf)
    docs = fx.table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"))
    fetched = (caps.select("url", "captured_at", F.when(F.col("capture_id") % 17 == 0, (F.col("doc_id") + 1) % n)
                           .otherwise(F.col("doc_id")).alias("doc_id"))
               .join(docs, "doc_id").select("url", "captured_at", "body"))
    return ql.fetched_check(wanted, fetched)


@register("redirect_prefixes", with_ctes("""
    SELECT p.prefix, 'redirects-' || p.prefix || '.csv' AS file, CAST(coalesce(n.n_lines, 0) AS BIGINT) AS n_lines
    FROM (SELECT unnest(string_split('234567ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS prefix) p
    LEFT JOIN (SELECT file, count(*) AS n_lines FROM redirects GROUP BY file) n
      ON n.file = 'redirects-' || p.prefix || '.csv'""", "redirects"))
def redirect_prefixes(spark, sf):
    """The 32 expected files with their line counts (0 for a missing file)."""
    from tidemark.sources.redirects import file_prefixes
    counts = fx.redirects(spark, sf).groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"))
    p = file_prefixes(spark).withColumn("file", F.concat(F.lit("redirects-"), "prefix", F.lit(".csv")))
    return p.join(counts, "file", "left").select("prefix", "file",
                                                 F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"))
