"""Catalogue part 6: sources and sinks round trips, lookups, snippets and streaming ingest.

Round-trip queries write relations derived from the driver tables into a fresh folder under the session's
``spark.checkpoint.dir`` (shared storage on a cluster) and read them back through the library's readers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark import functions as tf
from tidemark.operators import reconcile as rc
from tidemark.operators import search as srch
from tidemark.plans import fixtures as fx
from tidemark.plans.catalog import register
from tidemark.plans.oracle import MAX_TOKEN_BYTES, TOKEN_PATTERN, d_digest, d_escape, d_redirect_html, q as lit, with_ctes
from tidemark.plans.q_search import PAGE_CTES, S_TERMS, search_oracle
from tidemark.session import checkpoint_dir, remove
from tidemark.sources import cdx, exchange, redirects as rd, store as stg


def _scratch(spark, name: str) -> str:
    return checkpoint_dir(spark, f"tidemark-{name}-{uuid.uuid4().hex}")


def _cdx_pages(spark, sf):
    path = _scratch(spark, "cdx")
    cdx.write_pages(fx.captures(spark, sf), path)
    return cdx.read_pages(spark, path)


_DECODE_SQL = """
    SELECT surt, captured_at, url AS original, mime_type, status_code, digest, length, 'short' AS layout FROM captures"""


@register("cdx_decode", with_ctes(_DECODE_SQL, "captures"))
def cdx_decode(spark, sf):
    rows = cdx.decode_rows(_cdx_pages(spark, sf))
    return rows.where("_error IS NULL").select("surt", "captured_at", "original", "mime_type", "status_code",
                                               "digest", "length", "layout")


@register("cdx_rejects", with_ctes("""
    SELECT url AS original, captured_at,
           CASE capture_id % 50 WHEN 1 THEN 'key' WHEN 2 THEN 'status' WHEN 3 THEN 'digest' ELSE 'length' END AS error
    FROM captures WHERE capture_id % 50 BETWEEN 1 AND 4""", "captures"))
def cdx_rejects(spark, sf):
    """S3 rejects: pages in which every 50th row has an upper-case key, a status, digest or length that is none."""
    k = F.col("capture_id") % 50
    bad = fx.captures(spark, sf).select(
        "capture_id", "captured_at", "url", "mime_type", "crawl_ts", F.when(k == 1, F.upper("surt")).otherwise(F.col("surt")).alias("surt"),
        F.when(k == 2, "20x").otherwise(F.col("status_code").cast("string")).alias("status_code"),
        F.when(k == 3, F.repeat(F.lit("1"), F.lit(32))).otherwise(F.col("digest")).alias("digest"),
        F.when(k == 4, "-5.").otherwise(F.col("length").cast("string")).alias("length"))
    path = _scratch(spark, "cdx-rejects")
    cdx.write_pages(bad, path)
    return (cdx.decode_rows(cdx.read_pages(spark, path)).where("_error IS NOT NULL")
            .select("original", "captured_at", F.col("_error").alias("error")))


@register("cdx_dump", with_ctes("""
    SELECT CAST(floor(floor(epoch_us(p.t0) / 1000) / 1000) AS BIGINT) AS crawl_s, coalesce(c.status_code, 0) AS status,
           c.mime_type, c.url AS original
    FROM captures c JOIN (SELECT floor(capture_id / 10000) AS page_no, min(crawl_ts) AS t0 FROM captures GROUP BY 1) p
      ON p.page_no = floor(c.capture_id / 10000)""", "captures"))
def cdx_dump(spark, sf):
    return cdx.cdx_dump(cdx.decode_rows(_cdx_pages(spark, sf)))


@register("cdx_digests", with_ctes("SELECT digest FROM captures", "captures"))
def cdx_digests(spark, sf):
    return cdx.page_digests(_cdx_pages(spark, sf))


_EXACT_KEY = "com,example,site3)/u/15/view"
_PREFIX_KEY = "com,example,site3)/u/1"


@register("cdx_lookup_exact", with_ctes(f"""
    SELECT surt, captured_at, url, status_code, digest FROM captures WHERE surt = '{_EXACT_KEY}'""", "captures"))
def cdx_lookup_exact(spark, sf):
    return cdx.lookup(fx.captures(spark, sf), _EXACT_KEY, True).select("surt", "captured_at", "url", "status_code",
                                                                         "digest")


@register("cdx_lookup_prefix", with_ctes(f"""
    SELECT surt, captured_at, url, status_code, digest FROM captures WHERE starts_with(surt, '{_PREFIX_KEY}')""",
                                         "captures"))
def cdx_lookup_prefix(spark, sf):
    return cdx.lookup(fx.captures(spark, sf), _PREFIX_KEY, False).select("surt", "captured_at", "url", "status_code",
                                                                           "digest")


# ---------------------------------------------------------------- redirect files
def _redirect_files(spark, sf):
    path = _scratch(spark, "redirects")
    r = fx.redirects(spark, sf)
    (r.repartition("file").sortWithinPartitions("file", "line_no").select("file", "line")
     .write.partitionBy("file").text(path))
    got = rd.read_redirects(spark, path)
    return got.withColumn("file", F.regexp_extract("file", r"file=([^/]+)/", 1))


@register("redirect_read", with_ctes("SELECT file, line_no, digest, url FROM redirects", "redirects"))
def redirect_read(spark, sf):
    return _redirect_files(spark, sf).select("file", "line_no", "digest", "url")


@register("redirect_export", with_ctes("SELECT file, line_no, digest FROM redirects", "redirects"))
def redirect_export(spark, sf):
    return rd.export_digests(_redirect_files(spark, sf))


@register("redirect_merge", with_ctes(f"""
    SELECT DISTINCT 'redirects-' || substr(line, 1, 1) || '.csv' AS file, line FROM (
      SELECT line FROM redirects
      UNION ALL
      SELECT {d_digest(d_redirect_html('loc'))} || ',' || loc FROM (
        SELECT 'https://' || array_to_string(list_reverse(string_split(split_part(surt, ')', 1), ',')), '.')
                 || substr(surt, length(split_part(surt, ')', 1)) + 2) AS loc
        FROM captures WHERE status_code = 302))""", "redirects", "captures"))
def redirect_merge(spark, sf):
    """Merge new canned-redirect lines (302 captures -> their canonical URL) into the prefix-sharded dataset."""
    loc = tf.surt_canonical_url("surt")
    new = (fx.captures(spark, sf).where(F.col("status_code") == 302)
           .select(F.concat_ws(",", tf.content_digest(tf.redirect_html(loc)), loc).alias("line")))
    merged = fx.redirects(spark, sf).select("line").unionByName(new)
    path = _scratch(spark, "redirect-merge")
    rd.write_redirects(merged, path)
    return spark.read.text(path).select("file", F.col("value").alias("line"))


# ---------------------------------------------------------------- exchange formats
_E4_SQL = """
    SELECT url, captured_at, digest FROM (
      SELECT *, row_number() OVER (PARTITION BY digest ORDER BY strlen(url), captured_at, url) AS rn
      FROM captures c WHERE mime_type = 'text/html' AND (status_code IS NULL OR status_code = 200)
        AND NOT EXISTS (SELECT 1 FROM success s WHERE s.surt = c.surt AND s.captured_at = c.captured_at))
    WHERE rn = 1"""


@register("missing_csv_roundtrip", with_ctes(_E4_SQL, "captures", "success"))
def missing_csv_roundtrip(spark, sf):
    best = rc.missing_best_per_digest(rc.missing_captures(fx.captures(spark, sf), fx.success(spark, sf)))
    path = _scratch(spark, "missing-csv")
    exchange.write_missing(best, path)
    return exchange.read_missing(spark, path)


@register("invalid_csv_roundtrip", with_ctes("""
    SELECT c.url, c.captured_at, c.digest AS expected, s.snapshot AS actual
    FROM success s JOIN captures c ON c.capture_id = s.capture_id WHERE NOT s.correct_digest""", "success", "captures"))
def invalid_csv_roundtrip(spark, sf):
    inv = rc.invalid_digests(fx.captures(spark, sf), fx.success(spark, sf))
    path = _scratch(spark, "invalid-csv")
    exchange.write_invalid(inv, path)
    return exchange.read_invalid(spark, path)


@register("digest_list_text", with_ctes("SELECT digest FROM digest_list", "digest_list"))
def digest_list_text(spark, sf):
    path = _scratch(spark, "digest-list")
    fx.digest_list(spark, sf).write.text(path)
    return exchange.read_digest_list(spark, path)


@register("pattern_config", with_ctes("SELECT slug, surt, prefix, sort_id FROM patterns", "patterns"))
def pattern_config(spark, sf):
    p = fx.patterns(spark, sf)
    path = _scratch(spark, "patterns-json")
    p.select(F.col("sort_id").cast("long").alias("id"), tf.pattern_query("surt", "prefix").alias("query"), "name", "slug",
             F.col("sort_id").alias("sort")).write.json(path)
    return exchange.read_pattern_config(spark, path, multi_line=False).select("slug", "surt", "prefix", "sort_id")


# ---------------------------------------------------------------- body store
@register("store_roundtrip", with_ctes(f"""
    SELECT digest, true AS path_ok, body AS text, {d_digest('body')} = digest AS digest_ok FROM store""", "store"))
def store_roundtrip(spark, sf):
    root = _scratch(spark, "store")
    written = stg.write_store(fx.store(spark, sf).select("digest", "body"), root)
    written.write.mode("overwrite").parquet(root + "-manifest")  # run the writer once, keep its report
    listed = stg.list_store(spark, root).select("path", "digest", "path_ok")
    bodies = stg.read_bodies(spark, root).select("path", "text")
    return (listed.join(bodies, "path")
            .select("digest", "path_ok", "text", (tf.content_digest("text") == F.col("digest")).alias("digest_ok")))


@register("store_save", with_ctes(f"""
    SELECT digest, digest IN (SELECT digest FROM store) AS skipped,
           CASE WHEN digest NOT IN (SELECT digest FROM store) THEN text END AS text
    FROM (SELECT DISTINCT digest, text FROM (SELECT digest, text FROM docd
                                             UNION ALL SELECT {d_digest('text')}, text FROM benchmark))""", "docd", "store"))
def store_save(spark, sf):
    """Every document and benchmark body is saved where the store lacks it; what was written is read back."""
    root = _scratch(spark, "store-save")
    items = (fx.table(spark, sf, "documents").select("text").unionByName(fx.table(spark, sf, "benchmark").select("text"))
             .select(tf.content_digest("text").alias("digest"), F.col("text").alias("body")))
    stg.save_bodies(items, fx.store(spark, sf), root).write.parquet(root + "-manifest")   # runs the writer once
    report = spark.read.parquet(root + "-manifest")
    bodies = stg.read_bodies(spark, root).select("digest", "text")
    return report.join(bodies, "digest", "left").select("digest", F.col("path").isNull().alias("skipped"), "text")


@register("store_fetch", with_ctes("""
    SELECT st.digest, st.body FROM store st WHERE st.digest IN (SELECT expected FROM (
      SELECT c.digest AS expected FROM success s JOIN captures c ON c.capture_id = s.capture_id WHERE NOT s.correct_digest))""",
                                   "store", "success", "captures"))
def store_fetch(spark, sf):
    wanted = rc.invalid_digests(fx.captures(spark, sf), fx.success(spark, sf)).select(F.col("expected").alias("digest"))
    return stg.fetch(wanted, fx.store(spark, sf).select("digest", "body"))


# ---------------------------------------------------------------- snippets (rows-only) and streaming
SNIPPET_CHARS = 200
#: Snippets as DuckDB states them: every token's offsets, every window's words by a join, the best window's text.
SNIPPET_CTES = (
    ("n_text", """SELECT h.rank, h.surt, h.snapshot, h.score, coalesce(d.content, '') AS text
                  FROM q_hits h JOIN search_docs d ON d.snapshot = h.snapshot"""),
    ("n_cut", f"""SELECT snapshot, i, toks[i] AS t, length(gaps[i]) AS gap, length(toks[i]) AS n FROM (
                    SELECT snapshot, toks, gaps, unnest(range(1, len(toks) + 1)) AS i FROM (
                      SELECT snapshot, regexp_extract_all(text, {lit(TOKEN_PATTERN)}, 1) AS toks,
                             regexp_split_to_array(text, {lit(TOKEN_PATTERN)}) AS gaps FROM n_text))"""),
    ("n_tok", f"""SELECT snapshot, e - n AS s, e, lower(t) IN ('nicht', 'dans') AS hit FROM (
                    SELECT *, CAST(sum(gap + n) OVER (PARTITION BY snapshot ORDER BY i) AS BIGINT) AS e FROM n_cut)
                  WHERE strlen(t) < {MAX_TOKEN_BYTES}"""),
    ("n_window", f"""SELECT a.snapshot, a.s, max(b.e) AS e, count(*) FILTER (b.hit) AS score,
                       list_sort(list({{'s': b.s, 'e': b.e}}) FILTER (b.hit)) AS ranges
                     FROM n_tok a JOIN n_tok b ON b.snapshot = a.snapshot AND b.s >= a.s AND b.e <= a.s + {SNIPPET_CHARS}
                     GROUP BY a.snapshot, a.s"""),
    ("n_best", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot ORDER BY score DESC, s) AS rn FROM n_window)
                  WHERE rn = 1"""),
    ("n_snippet", f"""SELECT x.rank, x.surt, x.snapshot, x.score,
        CASE WHEN b.s IS NULL THEN {d_escape(f"substr(x.text, 1, {SNIPPET_CHARS})")}
             WHEN b.ranges IS NULL THEN {d_escape("substr(x.text, b.s + 1, b.e - b.s)")}
             ELSE array_to_string(list_transform(range(1, len(b.ranges) + 1), lambda k:
               {d_escape("substr(x.text, CASE WHEN k = 1 THEN b.s ELSE b.ranges[k - 1].e END + 1, b.ranges[k].s - CASE WHEN k = 1 THEN b.s ELSE b.ranges[k - 1].e END)")}
               || '<b>' || {d_escape("substr(x.text, b.ranges[k].s + 1, b.ranges[k].e - b.ranges[k].s)")} || '</b>'), '')
               || {d_escape("substr(x.text, b.ranges[len(b.ranges)].e + 1, b.e - b.ranges[len(b.ranges)].e)")} END AS snippet
        FROM n_text x LEFT JOIN n_best b ON b.snapshot = x.snapshot"""),
)


@register("snippets", search_oracle("SELECT rank, surt, snapshot, round(score, 6) AS score, snippet FROM n_snippet", S_TERMS,
                                    "success", extra=PAGE_CTES + SNIPPET_CTES))
def snippets(spark, sf):
    from tidemark.operators.snippet import snippets as make
    from tidemark.plans.q_search import PAGE, Q_TERMS
    docs = fx.search_docs(spark, sf)
    m = srch.search_matches(docs, fx.postings(spark, sf), Q_TERMS)
    top = srch.top_surts(m, PAGE, 0)
    hits = srch.group_hits(m, top).select("rank", "surt", "snapshot", "score")
    return (make(hits.join(docs.select("snapshot", "content"), "snapshot"), Q_TERMS, SNIPPET_CHARS)
            .withColumn("score", F.round("score", 6)))


@register("page_snippets", search_oracle("""
    SELECT t.rank, t.surt, ti.title, n.snapshot, n.captured_at, round(n.score, 6) AS score, s.snippet,
           'https://web.archive.org/web/' || strftime(n.captured_at, '%Y%m%d%H%M%S') || '/' || 'https://'
             || array_to_string(list_reverse(string_split(split_part(t.surt, ')', 1), ',')), '.')
             || substr(t.surt, length(split_part(t.surt, ')', 1)) + 2) AS archive_url
    FROM q_top t JOIN q_titles ti ON ti.surt = t.surt JOIN q_hits n ON n.surt = t.surt
    JOIN n_snippet s ON s.snapshot = n.snapshot""", S_TERMS, "success", extra=PAGE_CTES + SNIPPET_CTES))
def page_snippets(spark, sf):
    """The hits of a result page, newest first within a URL, each with replay URL and highlighted snippet, as the
    search request returns them."""
    from tidemark.plans.q_search import PAGE, Q_TERMS
    r = srch.search(fx.search_docs(spark, sf), fx.postings(spark, sf), fx.success(spark, sf), fx.patterns(spark, sf),
                    Q_TERMS, limit=PAGE, snippet_chars=SNIPPET_CHARS)
    return r.page_hits.withColumn("score", F.round("score", 6))


@register("stream_ingest", with_ctes("""
    SELECT surt, captured_at, original, mime_type, status_code, digest, length FROM (
      SELECT *, row_number() OVER (PARTITION BY surt, captured_at ORDER BY crawl_ts, page, capture_id) AS rn FROM crawl)
      JOIN (SELECT capture_id AS cid, url AS original FROM captures) ON cid = capture_id
    WHERE rn = 1""", "crawl", "captures"))
def stream_ingest(spark, sf):
    """Two page folders (first crawl, then the re-crawl) ingested by one availableNow stream run each."""
    from tidemark.streaming.ingest import ingest
    base = _scratch(spark, "stream")
    cr = fx.crawl(spark, sf)
    first = cr.where(F.col("page") == 0).drop("page")
    again = cr.where(F.col("page") == 1).drop("page")
    cdx.write_pages(first, f"{base}/pages/run=0")
    ingest(spark, f"{base}/pages", f"{base}/table", f"{base}/ckpt")
    cdx.write_pages(again, f"{base}/pages/run=1")
    ingest(spark, f"{base}/pages", f"{base}/table", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/table").select("surt", "captured_at", "original", "mime_type", "status_code",
                                                      "digest", "length")


@register("cdx_import", with_ctes("""
    SELECT f.surt, f.captured_at, f.status_code, f.digest, p.slug
    FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY surt, captured_at ORDER BY crawl_ts, page, capture_id) AS rn
                         FROM crawl) WHERE rn = 1) f
    JOIN (SELECT DISTINCT surt FROM crawl) s ON s.surt = f.surt
    LEFT JOIN patterns p ON starts_with(f.surt, p.surt)""", "crawl", "patterns"))
def cdx_import(spark, sf):
    """The import job over CDX pages (first crawl and re-crawl) into empty tables: pages -> W2 -> I1, I2, I7. The
    three tables are written on their natural keys (surt; surt and time; plus slug) and read back joined."""
    from tidemark.operators.patterns import assign_patterns
    base = _scratch(spark, "import")
    cr = fx.crawl(spark, sf)
    cdx.write_pages(cr.where("page = 0").drop("page"), f"{base}/run=0")
    cdx.write_pages(cr.where("page = 1").drop("page"), f"{base}/run=1")
    rows = cdx.decode_rows(cdx.read_pages(spark, base)).where("_error IS NULL")
    out = _scratch(spark, "imported")
    upsert_entries(spark.createDataFrame([], "surt string, captured_at timestamp"), rows).write.parquet(f"{out}/entries")
    entries = spark.read.parquet(f"{out}/entries")
    upsert_surts(spark.createDataFrame([], "surt string"), entries).write.parquet(f"{out}/surts")
    key = F.xxhash64("surt", "captured_at").alias("capture_id")
    (assign_patterns(entries.select("surt", "captured_at", key), fx.patterns(spark, sf))
     .select("surt", "captured_at", "slug").write.parquet(f"{out}/members"))
    return (entries.join(spark.read.parquet(f"{out}/surts"), "surt")
            .join(spark.read.parquet(f"{out}/members"), ["surt", "captured_at"], "left")
            .select("surt", "captured_at", "status_code", "digest", "slug"))


def upsert_entries(table, rows):
    from tidemark.operators.dedup import first_by
    first = first_by(rows.select("surt", "captured_at", "page_ts", "file", "pos", "original", "status_code", "digest"),
                     ["surt", "captured_at"], ["page_ts", "file", "pos"])
    return first.join(table.select("surt", "captured_at"), ["surt", "captured_at"], "left_anti")


def upsert_surts(table, entries):
    from tidemark.operators.upsert import new_keys
    return new_keys(entries.select("surt"), table, ["surt"])


@register("search_response_json", None)
def search_response_json(spark, sf):
    """The search response as JSON lines: one document per hit capture, nesting its page (rank, URL, title,
    counts) and the hit (instant, snapshot, score, replay URL). Pages and hits are joined, not collected, so a URL
    with very many captures never becomes one giant record."""
    from tidemark.plans.q_search import PAGE, Q_TERMS
    r = srch.search(fx.search_docs(spark, sf), fx.postings(spark, sf), fx.success(spark, sf), fx.patterns(spark, sf),
                    Q_TERMS, limit=PAGE)
    pages, caps = r.pages, srch.hit_captures(r.hits, fx.success(spark, sf))
    page = F.struct("rank", "surt", "canonical_url", "title", "score", "n_hits", "n_captures")
    hit = F.struct(F.col("captured_at"), F.col("snapshot"), F.col("hit_score").alias("score"),
                   tf.archive_url(F.col("canonical_url"), F.col("captured_at")).alias("archive_url"))
    j = caps.withColumnRenamed("score", "hit_score").drop("rank").join(pages, "surt")
    return j.select("rank", "captured_at", F.to_json(F.struct(page.alias("page"), hit.alias("hit"))).alias("json"))


_RESPONSE_SCHEMA = ("page struct<rank: int, surt: string, title: string, score: double, n_hits: long>, "
                    "hit struct<captured_at: timestamp, snapshot: string, score: double, archive_url: string>")


@register("search_response", search_oracle("""
    SELECT t.rank, t.surt, ti.title, round(t.best, 6) AS page_score, t.n_hits, c.captured_at, c.snapshot,
           round(c.score, 6) AS hit_score,
           'https://web.archive.org/web/' || strftime(c.captured_at, '%Y%m%d%H%M%S') || '/' || 'https://'
             || array_to_string(list_reverse(string_split(split_part(t.surt, ')', 1), ',')), '.')
             || substr(t.surt, length(split_part(t.surt, ')', 1)) + 2) AS archive_url
    FROM q_caps c JOIN q_top t ON t.surt = c.surt JOIN q_titles ti ON ti.surt = t.surt""", S_TERMS, "success", extra=PAGE_CTES))
def search_response(spark, sf):
    """The response's JSON lines, read back as typed columns."""
    r = search_response_json(spark, sf).select(F.from_json("json", _RESPONSE_SCHEMA).alias("j")).select("j.page", "j.hit")
    return r.select("page.rank", "page.surt", "page.title", F.round("page.score", 6).alias("page_score"), "page.n_hits",
                    "hit.captured_at", "hit.snapshot", F.round("hit.score", 6).alias("hit_score"), "hit.archive_url")


@register("stream_reindex", with_ctes("SELECT snapshot, field, pos, token FROM postings", "postings"))
def stream_reindex(spark, sf):
    """Newly indexed documents arrive as parquet files in two batches; a file stream tokenises each batch into
    the postings table (availableNow), skipping documents already indexed."""
    from tidemark.streaming.ingest import reindex
    base = _scratch(spark, "reindex")
    docs = fx.search_docs(spark, sf)
    docs.where(F.col("year") < 2020).write.parquet(f"{base}/docs/b=0")
    reindex(spark, f"{base}/docs", docs.schema, f"{base}/postings", f"{base}/ckpt")
    docs.where(F.col("year") >= 2020).write.parquet(f"{base}/docs/b=1")
    reindex(spark, f"{base}/docs", docs.schema, f"{base}/postings", f"{base}/ckpt")
    return srch.occurrences(spark.read.parquet(f"{base}/postings")).select("snapshot", "field", "pos", "token")


def _replaced_index(spark, sf):
    """An index that first took an outdated form of every document before 2020, then every document as it is. The files
    of a batch go when the index holds their rows."""
    from tidemark.streaming.index import SearchIndex
    from tidemark.streaming.ingest import reindex
    base = _scratch(spark, "reindex-replace")
    docs = fx.search_docs(spark, sf)
    old = (docs.where(F.col("year") < 2020).withColumn("content", F.concat(F.lit("obsolete words "), F.reverse("content")))
           .withColumn("title", F.lit("obsolete")).withColumn("captured_at", F.col("captured_at") - F.expr("INTERVAL 1 DAY")))
    for i, batch in enumerate((old, docs)):
        batch.write.option("compression", "zstd").parquet(f"{base}/docs/b={i}")
        reindex(spark, f"{base}/docs", docs.schema, f"{base}/index", f"{base}/ckpt")
        remove(spark, f"{base}/docs/b={i}")
    return SearchIndex(spark, f"{base}/index")


@register("stream_reindex_replace", with_ctes("""
    SELECT p.snapshot, p.field, p.pos, p.token, l.dl FROM postings p
    JOIN field_lengths l ON l.snapshot = p.snapshot AND l.field = p.field""", "postings", "field_lengths"))
def stream_reindex_replace(spark, sf):
    """Changed documents replace their postings and lengths: those of a rebuild, though nothing was rebuilt."""
    return srch.occurrences(_replaced_index(spark, sf).postings())


@register("stream_reindex_docs", with_ctes("""
    SELECT d.snapshot, d.title, d.year, t.dl AS title_dl, c.dl AS content_dl FROM search_docs d
    JOIN field_lengths t ON t.snapshot = d.snapshot AND t.field = 'title'
    JOIN field_lengths c ON c.snapshot = d.snapshot AND c.field = 'content'""", "search_docs", "field_lengths"))
def stream_reindex_docs(spark, sf):
    """The document rows after the replacement."""
    return _replaced_index(spark, sf).docs().select("snapshot", "title", "year", "title_dl", "content_dl")


@register("index_compaction", with_ctes("""
    SELECT p.field, p.token, count(DISTINCT p.snapshot) AS df, count(*) AS cf
    FROM postings p JOIN search_docs d ON d.snapshot = p.snapshot WHERE d.year % 3 <> 0 GROUP BY p.field, p.token""",
                                        "postings", "search_docs"))
def index_compaction(spark, sf):
    """Documents of every third year are deleted, the generations compacted into one: the collection
    statistics are those of the documents that are left."""
    index = _replaced_index(spark, sf)
    index.apply(index.docs().where(F.col("year") % 3 == 0).withColumn("deleted", F.lit(True)))
    index.compact()
    return srch.collection_stats(index.postings())


@register("legacy_import", with_ctes(f"""
    SELECT digest, {d_digest('text')} = digest AS digest_ok, digest NOT IN (SELECT digest FROM store) AS to_import
    FROM (SELECT DISTINCT digest, text FROM (
            SELECT digest, text FROM docd
            UNION ALL SELECT {d_digest('text')}, text FROM benchmark))""", "docd", "store"))
def legacy_import(spark, sf):
    """A legacy gzip store holding every document and benchmark body is listed and read back;
    each body is re-hashed and flagged for import when the new store lacks it."""
    root = _scratch(spark, "legacy")
    bodies = (fx.table(spark, sf, "documents").select("text")
              .unionByName(fx.table(spark, sf, "benchmark").select("text"))
              .select(tf.content_digest("text").alias("digest"), F.col("text").alias("body"))
              .dropDuplicates(["digest"]))
    stg.write_legacy_store(bodies, root).write.mode("overwrite").parquet(root + "-manifest")
    got = stg.read_legacy_bodies(spark, root).where("digest IS NOT NULL")
    stored = fx.store(spark, sf).select("digest", F.lit(True).alias("stored"))
    return (got.join(stored, "digest", "left")
            .select("digest", (tf.content_digest("text") == F.col("digest")).alias("digest_ok"),
                    F.col("stored").isNull().alias("to_import")))


@register("cdx_query_log", with_ctes("""
    SELECT CAST(floor(epoch_us(min(c.crawl_ts)) / 1000) AS BIGINT) AS epoch_ms,
           'https://' || array_to_string(list_reverse(string_split(split_part(p.surt, ')', 1), ',')), '.')
             || substr(p.surt, length(split_part(p.surt, ')', 1)) + 2) || CASE WHEN p.prefix THEN '*' ELSE '' END AS query
    FROM patterns p JOIN pattern_entry pe ON pe.slug = p.slug JOIN captures c ON c.capture_id = pe.capture_id
    GROUP BY p.surt, p.prefix""", "patterns", "pattern_entry", "captures"))
def cdx_query_log(spark, sf):
    """Each collection's index lookup (its query URL) logged at the time its first page was fetched."""
    pe = fx.pattern_entry(spark, sf).join(fx.captures(spark, sf).select("capture_id", "crawl_ts"), "capture_id")
    first = pe.groupBy("slug").agg(F.min("crawl_ts").alias("t0"))
    log = (fx.patterns(spark, sf).join(first, "slug")
           .select(F.unix_millis(F.col("t0").cast("timestamp")).alias("epoch_ms"),
                   tf.pattern_query("surt", "prefix").alias("query")))
    path = _scratch(spark, "query-log")
    cdx.write_query_log(log, path)
    return cdx.read_query_log(spark, path)
