"""Catalogue part 7: jobs on real body stores, damaged files included: bulk import (S11, S12, J10), validation with an
error channel (Q1, Q2, S9). Files are derived from the driver tables and written by tasks; paths in the results are
relative to the store."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import functions as tf
from tidemark.operators import bulk_import as imp
from tidemark.operators import quality as ql
from tidemark.plans import fixtures as fx
from tidemark.plans.catalog import register
from tidemark.plans.oracle import d_digest, with_ctes
from tidemark.plans.q_sources import _scratch
from tidemark.sources import cdx, clustered as cl, store as stg


def _loc(d: str) -> str:
    return f"substr({d}, 1, 2) || '/' || substr({d}, 3, 2) || '/' || {d} || '.zst'"


def _run(df) -> None:
    """Runs a writing job for its files only."""
    df.write.format("noop").mode("overwrite").save()


def _half(content):
    return F.substring(content, 1, (F.length(content) / 2).cast("int"))


# ---------------------------------------------------------------- Q1 / Q2 on files

_PAGE_BY_URL = "SELECT url, min(page_id) AS id, arg_min(html, page_id) AS html FROM pages GROUP BY url"
_STORE_FILES_SQL = f"""
    SELECT '/' || {_loc('digest')} AS path, digest AS expected, digest AS actual, 'ok' AS status FROM store
    UNION
    SELECT '/' || {_loc(d_digest('url'))}, {d_digest('url')}, CASE WHEN id % 4 = 0 THEN {d_digest('html')} END,
           CASE WHEN id % 4 = 0 THEN 'invalid_digest' ELSE 'io_error' END
    FROM ({_PAGE_BY_URL}) WHERE id % 4 < 3
    UNION
    SELECT '/' || {_loc(d_digest('html'))}, {d_digest('html')}, {d_digest('html')}, 'ok'
    FROM ({_PAGE_BY_URL}) WHERE id % 4 = 3
    UNION
    SELECT '/misc/' || CAST(item_id AS VARCHAR) || '.zst', NULL, NULL, 'unexpected_path' FROM benchmark
    UNION
    SELECT '/' || replace({_loc(d_digest('text'))}, '.zst', '.txt'), NULL, NULL, 'unexpected_path' FROM benchmark"""


def _store_with_damage(spark, sf) -> str:
    """A store written by ``save_bodies``, and beside its files: page bodies filed under their URL's digest (whole: wrong
    digest; cut in half or with bytes behind the frame: unreadable), page bodies in two frames (right), and files
    outside the layout."""
    root = _scratch(spark, "store-files")
    empty = spark.createDataFrame([], "digest string")
    _run(stg.save_bodies(fx.store(spark, sf).select("digest", "body"), empty, root))
    page = (fx.table(spark, sf, "pages").groupBy("url").agg(F.min("page_id").alias("id"), F.min_by("html", "page_id").alias("html")))
    k = F.col("id") % 4
    half = (F.char_length("html") / 2).cast("int")
    whole = stg.zstd_compress(F.col("html").cast("binary"))
    two = F.concat(stg.zstd_compress(F.substring("html", 1, half).cast("binary")),
                   stg.zstd_compress(F.substring("html", half + 1, F.char_length("html")).cast("binary")))
    content = (F.when(k == 0, F.col("whole")).when(k == 1, _half(F.col("whole")))
               .when(k == 2, F.concat("whole", F.lit("behind").cast("binary"))).otherwise(F.col("two")))
    pages = (page.withColumn("whole", whole).withColumn("two", two)
             .select(tf.store_location(tf.content_digest(F.when(k == 3, F.col("html")).otherwise(F.col("url")))).alias("path"),
                     content.alias("content")))
    b = fx.table(spark, sf, "benchmark")
    text = F.col("text").cast("binary").alias("content")
    stray = b.select(F.concat(F.lit("misc/"), F.col("item_id").cast("string"), F.lit(".zst")).alias("path"), text).unionByName(
        b.select(F.replace(tf.store_location(tf.content_digest("text")), F.lit(".zst"), F.lit(".txt")).alias("path"), text))
    _run(stg.write_files(pages.unionByName(stray), root))
    return root


@register("store_files_validate", with_ctes(_STORE_FILES_SQL, "store"))
def store_files_validate(spark, sf):
    """Q1 over the files of a store: every file, read and decoded, gets its status."""
    return ql.validate_store(stg.read_store_files(spark, _store_with_damage(spark, sf)))


@register("store_files_invalid", with_ctes(f"SELECT path, status FROM ({_STORE_FILES_SQL}) WHERE status IN "
                                           "('invalid_digest', 'io_error')", "store"))
def store_files_invalid(spark, sf):
    """Q2 over the files of a store."""
    files = stg.read_store_files(spark, _store_with_damage(spark, sf))
    return ql.invalid_files(ql.validate_store(files)).select("path", "status")


@register("store_decode_errors", with_ctes(f"""
    SELECT '/' || {_loc(d_digest('url'))} AS path, CASE WHEN id % 4 = 1 THEN 'truncated frame' ELSE 'trailing bytes' END AS error
    FROM ({_PAGE_BY_URL}) WHERE id % 4 IN (1, 2)"""))
def store_decode_errors(spark, sf):
    """S9's error channel: what is wrong with each body that can't be read."""
    return (stg.read_store_files(spark, _store_with_damage(spark, sf)).where("error IS NOT NULL")
            .select("path", "error"))


# ---------------------------------------------------------------- S11 / S12 / J10

_ITEMS_SQL = f"""
    SELECT min(item_id) AS id, text, {d_digest('text')} AS digest FROM benchmark
    WHERE {d_digest('text')} NOT IN (SELECT digest FROM docd) GROUP BY text"""
_LEGACY_SQL = f"""
    SELECT substr(digest, 1, 1) || '/' || digest || '.gz' AS path, digest,
           CASE WHEN digest IN (SELECT digest FROM store) OR digest IN (SELECT digest FROM redirects) THEN 'skipped' ELSE 'written' END AS outcome,
           CASE WHEN digest IN (SELECT digest FROM store) THEN 'stored'
                WHEN digest IN (SELECT digest FROM redirects) THEN 'redirect' END AS reason
    FROM (SELECT DISTINCT digest FROM docd)
    UNION ALL
    SELECT CASE WHEN id % 4 = 1 THEN CASE WHEN digest[1] = 'B' THEN 'A' ELSE 'B' END ELSE digest[1] END || '/' || digest
             || CASE WHEN id % 4 = 2 THEN '.txt' ELSE '.gz' END,
           CASE WHEN id % 4 IN (0, 3) THEN digest END, 'rejected',
           CASE id % 4 WHEN 0 THEN 'truncated member' WHEN 1 THEN 'letter' WHEN 2 THEN 'suffix' ELSE 'digest' END
    FROM ({_ITEMS_SQL})
    UNION ALL
    SELECT 'misc/' || CAST(id AS VARCHAR) || '.gz', NULL, 'rejected', 'folder' FROM ({_ITEMS_SQL})"""


def _legacy_source(spark, sf) -> str:
    """A legacy store of all document bodies, and of benchmark bodies that are cut off, in the wrong folder, of the wrong
    suffix, not what their name says, or outside the layout."""
    root = _scratch(spark, "legacy-source")
    bodies = fx.table(spark, sf, "documents").select(F.col("text").alias("body")).distinct()
    bodies = bodies.select(tf.content_digest("body").alias("digest"), "body")
    item = (fx.table(spark, sf, "benchmark").groupBy("text").agg(F.min("item_id").alias("id"))
            .withColumn("digest", tf.content_digest("text")).join(bodies.select("digest"), "digest", "left_anti"))
    k, letter = F.col("id") % 4, F.substring("digest", 1, 1)
    other = F.when(letter == "B", "A").otherwise("B")
    whole = stg.gzip_compress(F.when(k == 3, F.reverse("text")).otherwise(F.col("text")).cast("binary"))
    item = item.withColumn("whole", whole)
    items = item.select(F.concat(F.when(k == 1, other).otherwise(letter), F.lit("/"), "digest",
                                 F.when(k == 2, ".txt").otherwise(".gz")).alias("path"),
                        F.when(k == 0, _half(F.col("whole"))).otherwise(F.col("whole")).alias("content"))
    stray = item.select(F.concat(F.lit("misc/"), F.col("id").cast("string"), F.lit(".gz")).alias("path"), F.col("whole").alias("content"))
    _run(stg.write_legacy_store(bodies, root))
    _run(stg.write_files(items.unionByName(stray), root))
    return root


@register("bulk_import_legacy", with_ctes(f"""
    SELECT *, CASE WHEN outcome = 'written' THEN true END AS readable FROM ({_LEGACY_SQL})""", "docd", "store", "redirects"))
def bulk_import_legacy(spark, sf):
    """A legacy store is imported into a store that holds the fetched bodies; known redirects are left out. What
    was written is read back and hashed."""
    store = _scratch(spark, "import-store")
    _run(stg.save_bodies(fx.store(spark, sf).select("digest", "body"), spark.createDataFrame([], "digest string"), store))
    m = imp.run_import(spark, _legacy_source(spark, sf), store, "first", "legacy", fx.redirects(spark, sf).select("digest"))
    return _with_readable(spark, m, store).select("path", "digest", "outcome", "reason", "readable")


def _with_readable(spark, manifest, store):
    held = stg.read_bodies(spark, store).select(
        "digest", (tf.content_digest("body") == F.col("digest")).alias("ok"))
    return (manifest.join(held, "digest", "left")
            .withColumn("readable", F.when(F.col("outcome") == "written", F.coalesce("ok", F.lit(False)))))


_PLAIN_SQL = f"""
    SELECT CASE id % 5 WHEN 0 THEN 'page-' || CAST(id AS VARCHAR) WHEN 1 THEN 'sub/' || {d_digest('html')}
                WHEN 2 THEN {d_digest("html || '#'")} ELSE {d_digest('html')} END AS path,
           CASE WHEN id % 5 = 2 THEN {d_digest("html || '#'")} WHEN id % 5 > 2 THEN {d_digest('html')} END AS digest,
           CASE WHEN id % 5 < 3 THEN 'rejected' ELSE 'written' END AS outcome,
           CASE id % 5 WHEN 0 THEN 'name' WHEN 1 THEN 'folder' WHEN 2 THEN 'digest' END AS reason
    FROM (SELECT html, min(page_id) AS id FROM pages GROUP BY html)"""


@register("bulk_import_plain", with_ctes(f"""
    SELECT 1 AS run, path, digest, outcome, reason, CASE WHEN outcome = 'written' THEN true END AS readable FROM ({_PLAIN_SQL})
    UNION ALL
    SELECT 2, path, digest, CASE WHEN outcome = 'written' THEN 'skipped' ELSE outcome END,
           CASE WHEN outcome = 'written' THEN 'stored' ELSE reason END, NULL FROM ({_PLAIN_SQL})"""))
def bulk_import_plain(spark, sf):
    """A flat folder of page bodies is imported into an empty store; a second import of the same folder writes
    nothing."""
    source, store = _scratch(spark, "plain-source"), _scratch(spark, "plain-store")
    page = fx.table(spark, sf, "pages").groupBy("html").agg(F.min("page_id").alias("id"))
    k = F.col("id") % 5
    digest, wrong = tf.content_digest("html"), tf.content_digest(F.concat("html", F.lit("#")))
    name = (F.when(k == 0, F.concat(F.lit("page-"), F.col("id").cast("string"))).when(k == 1, F.concat(F.lit("sub/"), digest))
            .when(k == 2, wrong).otherwise(digest))
    _run(stg.write_files(page.select(name.alias("path"), F.col("html").cast("binary").alias("content")), source))
    runs = [imp.run_import(spark, source, store, f"run-{i}", "plain").withColumn("run", F.lit(i)) for i in (1, 2)]
    return (_with_readable(spark, runs[0].unionByName(runs[1]), store)
            .select("run", "path", "digest", "outcome", "reason", "readable"))


# ---------------------------------------------------------------- F10 / Q3 / S13 on layouts by prefix

@register("digest_by_prefix_files", with_ctes(f"""
    SELECT expected, actual FROM ({_STORE_FILES_SQL}) WHERE expected[1] = 'C'""", "store"))
def digest_by_prefix_files(spark, sf):
    """Q3 + F10 over the files of a store: the digests of one prefix, recomputed; only its folders are listed."""
    return ql.digests_by_prefix(stg.read_store_files(spark, _store_with_damage(spark, sf), "C"))


@register("store_prefix_table", with_ctes("""
    SELECT 'A' AS prefix, digest, length FROM store WHERE starts_with(digest, 'A')
    UNION ALL SELECT 'B2', digest, length FROM store WHERE starts_with(digest, 'B2')
    UNION ALL SELECT 'C3D', digest, length FROM store WHERE starts_with(digest, 'C3D')""", "store"))
def store_prefix_table(spark, sf):
    """F10 / S13 on a body table laid out by digest: prefixes that end in a level, with it, and in the next."""
    path = _scratch(spark, "store-by-prefix")
    cl.write_by_prefix(fx.store(spark, sf).select("digest", "length"), path, levels=(2,))
    out = None
    for p in ("A", "B2", "C3D"):
        own = cl.read_by_prefix(spark, path, p, levels=(2,)).withColumn("prefix", F.lit(p))
        out = own if out is None else out.unionByName(own)
    return out.select("prefix", "digest", "length")


@register("surt_captures", with_ctes("""
    SELECT c.surt, c.captured_at, c.status_code, s.snapshot, s.correct_digest, p.slug
    FROM captures c LEFT JOIN success s ON s.capture_id = c.capture_id LEFT JOIN pattern_entry p ON p.capture_id = c.capture_id
    WHERE starts_with(c.surt, 'com,example,site3)/u/')""", "captures", "success", "pattern_entry"))
def surt_captures(spark, sf):
    """F7 with J2: the captures below a URL prefix with their fetch results and collections, joined on tables that are
    bucketed alike (no shuffle) and sorted by SURT (only the prefix's row groups are read)."""
    c = cdx.lookup(fx.captures(spark, sf), "com,example,site3)/u/", False)
    s = fx.success(spark, sf).select("capture_id", "snapshot", "correct_digest")
    p = fx.pattern_entry(spark, sf).select("capture_id", "slug")
    return (c.join(s, "capture_id", "left").join(p, "capture_id", "left")
            .select("surt", "captured_at", "status_code", "snapshot", "correct_digest", "slug"))
