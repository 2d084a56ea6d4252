"""Catalogue part 4: HTML extraction (T1), link dump (S18), link graph (I8), avatar hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import surt_from_url
from tidemark.operators import extract as ex
from tidemark.operators import search as srch
from tidemark.plans import fixtures as fx
from tidemark.plans.catalog import register
from tidemark.plans.oracle import d_digest, d_resolve, d_surt, d_tokens, q, with_ctes
from tidemark.plans.q_search import Q_TERMS, S_TERMS, _bm25_sql, _idf_sql, search_oracle


def _unesc(x: str) -> str:
    return (f"replace(replace(replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'),"
            f" '&lt;', '<'), '&gt;', '>'), '&amp;', '&')")


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"


def _pages_docs(spark, sf, native=False):
    p = fx.table(spark, sf, "pages")
    if native:
        return ex.extract_native(p)
    return ex.extract_documents(p, "html", F.col("url"))


@register("html_title", "SELECT page_id, " + _strip(_unesc("regexp_extract(html, '<title>([^<]*)</title>', 1)"))
          + " AS title FROM pages")
def html_title(spark, sf):
    return _pages_docs(spark, sf).select("page_id", F.col("doc.title").alias("title"))


@register("html_title_native", "SELECT page_id, " + _strip(_unesc("regexp_extract(html, '<title>([^<]*)</title>', 1)"))
          + " AS title FROM pages")
def html_title_native(spark, sf):
    return _pages_docs(spark, sf, native=True).select("page_id", F.col("doc.title").alias("title"))


@register("html_text", f"""
    SELECT page_id, CAST(len(nodes) AS BIGINT) AS n_nodes, array_to_string(nodes, chr(10)) AS text FROM (
      SELECT page_id, list_filter(list_transform(regexp_extract_all(substr(html, strpos(html, '<body>')), '>([^<]+)<', 1),
                                                 lambda x: {_strip(_unesc('x'))}), lambda x: x <> '') AS nodes
      FROM pages)""")
def html_text(spark, sf):
    d = _pages_docs(spark, sf)
    return d.select("page_id", F.size("doc.content").cast("bigint").alias("n_nodes"),
                    F.array_join("doc.content", "\n").alias("text"))


@register("html_links", f"""
    SELECT page_id, CAST(i - 1 AS BIGINT) AS pos,
           CASE WHEN starts_with(href, 'http') THEN href ELSE origin || href END AS link
    FROM (SELECT page_id, origin, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS i
          FROM (SELECT page_id, {_ORIGIN} AS origin,
                       list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda h: trim({_unesc('h')})) AS hrefs
                FROM pages))
    WHERE starts_with(CASE WHEN starts_with(href, 'http') THEN href ELSE origin || href END, 'http')""")
def html_links(spark, sf):
    return ex.link_rows(_pages_docs(spark, sf)).select("page_id", F.col("pos").cast("bigint").alias("pos"), "link")


@register("link_graph", f"""
    SELECT DISTINCT page_id, link, link_surt FROM (
      SELECT page_id, link, {d_surt('link')} AS link_surt FROM (
        SELECT page_id, origin || trim({_unesc('h')}) AS link
        FROM (SELECT page_id, {_ORIGIN} AS origin, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM pages)))
    WHERE link_surt IS NOT NULL""")
def link_graph(spark, sf):
    return ex.link_graph(_pages_docs(spark, sf))


#: Links added to every page: every form of a reference (RFC 3986 section 4.2) and some that are no links of a page.
_ADDED = ("../up/a.html", "./here", "plain", "?q=1", "//cdn.example.org/x/../lib.js", "g;x=1/../y", "/abs/./b/../c/", "#top",
          "mailto:a@b.example", "HTTPS://Other.example/a/./b", "../../../../far/..", "", ".", "http://abs.example/p/../q",
          "d/e?x=/../y#z/..", "..")
#: <base> of every third page, each in its own form; a second one does not count.
_BASES = {1: "../base/dir/", 2: "https://base.example/b/c?d"}


def _linked_pages(spark, sf):
    p = fx.table(spark, sf, "pages")
    tag = F.lit("")
    for k, v in _BASES.items():
        tag = F.when(F.col("page_id") % 3 == k, f'<base href="{v}"><base href="http://second.example/">').otherwise(tag)
    anchors = "".join(f'<a href="{h}">x</a>' for h in _ADDED)
    return p.withColumn("html", F.concat(tag, F.coalesce("html", F.lit("")), F.lit(anchors)))


def _linked_sql() -> str:
    base = "CASE page_id % 3 " + " ".join(f"WHEN {k} THEN {d_resolve('url', q(v))}" for k, v in _BASES.items()) + " ELSE url END"
    added = "[" + ", ".join(q(h) for h in _ADDED) + "]"
    return f"""SELECT page_id, CAST(i - 1 AS BIGINT) AS n, CASE WHEN starts_with(href, 'http') THEN href ELSE {d_resolve('base', 'href')} END AS link
    FROM (SELECT page_id, base, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS i FROM (
      SELECT page_id, {base} AS base,
             list_concat(list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda h: trim({_unesc('h')})), {added}) AS hrefs
      FROM pages))
    WHERE href <> '' AND NOT starts_with(href, '#')
      AND regexp_matches(CASE WHEN starts_with(href, 'http') THEN href ELSE {d_resolve('base', 'href')} END, '^(?i:https?://)')"""


@register("html_links_resolved", f"""
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS pos, link FROM ({_linked_sql()})""")
def html_links_resolved(spark, sf):
    """Links of every form, resolved against the page or its <base>."""
    d = ex.extract_documents(_linked_pages(spark, sf), "html", F.col("url"))
    return ex.link_rows(d).select("page_id", F.col("pos").cast("bigint").alias("pos"), "link")


@register("link_graph_resolved", f"""
    SELECT DISTINCT page_id, link, link_surt FROM (SELECT page_id, link, {d_surt('link')} AS link_surt FROM ({_linked_sql()}))
    WHERE link_surt IS NOT NULL""")
def link_graph_resolved(spark, sf):
    """I8 over the resolved links."""
    return ex.link_graph(ex.extract_documents(_linked_pages(spark, sf), "html", F.col("url")))


@register("gravatar_extract", f"""
    SELECT page_id, md5(CAST(page_id AS VARCHAR)) AS hashes FROM pages""")
def gravatar_extract(spark, sf):
    p = fx.table(spark, sf, "pages")
    img = F.concat(F.lit('<img src="https://www.gravatar.com/avatar/'), F.md5(F.col("page_id").cast("string")),
                   F.lit('">'))
    p = p.withColumn("html", F.concat(F.coalesce("html", F.lit("")), img))
    d = ex.extract_documents(p, "html")
    return d.select("page_id", F.array_join("doc.gravatar_hashes", " ").alias("hashes"))


@register("gravatar_extract_native", f"""
    SELECT page_id, md5(CAST(page_id AS VARCHAR)) AS hashes FROM pages""")
def gravatar_extract_native(spark, sf):
    p = fx.table(spark, sf, "pages")
    img = F.concat(F.lit('<img src="https://www.gravatar.com/avatar/'), F.md5(F.col("page_id").cast("string")),
                   F.lit('">'))
    d = ex.extract_native(p.withColumn("html", F.concat(F.coalesce("html", F.lit("")), img)))
    return d.select("page_id", F.array_join("doc.gravatar_hashes", " ").alias("hashes"))


# ---------------------------------------------------------------- F6 / T2 / T3: the extracted pages as an index
_TITLE_SQL = _strip(_unesc("regexp_extract(html, '<title>([^<]*)</title>', 1)"))
_TEXT_SQL = f"array_to_string(list_transform(regexp_extract_all(substr(html, strpos(html, '<body>')), '>([^<]+)<', 1), lambda x: {_unesc('x')}), ' ')"


@register("search_gravatar", f"""
    SELECT page_id, title FROM (SELECT page_id, {_TITLE_SQL} AS title, {_TEXT_SQL} AS text FROM pages) p
    WHERE page_id % 5 = 3 AND (list_contains({d_tokens('title')}, 'the') OR list_contains({d_tokens('text')}, 'the'))""")
def search_gravatar(spark, sf):
    """Pages that show one of five avatars are extracted, indexed with their hashes, and searched by word and avatar."""
    p = fx.table(spark, sf, "pages")
    img = F.concat(F.lit('<img src="https://www.gravatar.com/avatar/'), F.md5((F.col("page_id") % 5).cast("string")),
                   F.lit('">'))
    d = ex.extract_documents(p.withColumn("html", F.concat(F.coalesce("html", F.lit("")), img)), "html")
    docs = d.select(F.col("page_id").cast("string").alias("snapshot"), surt_from_url("url").alias("surt"),
                    F.lit(None).cast("timestamp").alias("captured_at"), F.lit("pages").alias("slug"),
                    F.lit(None).cast("int").alias("year"), F.col("doc.title").alias("title"),
                    F.array_join("doc.content", "\n").alias("content"), F.col("doc.gravatar_hashes").alias("hashes"))
    query = srch.Query(should="the", gravatar_hash="eccbc87e4b5ce2fe28308fd9f2a7baf3")     # md5 of "3"
    m = srch.search_matches(docs, srch.postings(docs), query)
    return m.select(F.col("snapshot").cast("long").alias("page_id"), "title")


# ---------------------------------------------------------------- T2 from T1: the index of extracted pages
def _avatar(x: str) -> str:
    return f"'<img src=\"https://www.gravatar.com/avatar/' || md5({x}) || '\">'"


_SHARED = "'shared' || CAST(page_id % 5 AS VARCHAR)"
_PAGE_BODIES = f"""
    SELECT page_id, url, {d_surt('url')} AS surt, to_timestamp(1420070400 + page_id * 604800)::TIMESTAMP AS captured_at,
           regexp_extract(url, '^https?://([^/.]+)', 1) AS slug, html AS plain,
           coalesce(html, '') || {_avatar('CAST(page_id AS VARCHAR)')} || {_avatar(_SHARED)} AS body,
           list_sort([md5(CAST(page_id AS VARCHAR)), md5({_SHARED})]) AS hashes
    FROM pages"""
#: The relation that the ranking's CTEs read, over pages: title and text by patterns, not by a parser.
_PAGE_DOCS = {"search_docs": ((), f"""
    SELECT snapshot, surt, captured_at, slug, CAST(year(captured_at) AS INTEGER) AS year,
           {_strip(_unesc("regexp_extract(plain, '<title>([^<]*)</title>', 1)"))} AS title,
           array_to_string(list_filter(list_transform(regexp_extract_all(substr(plain, strpos(plain, '<body>')), '>([^<]+)<', 1),
                                                      lambda x: {_strip(_unesc('x'))}), lambda x: x <> ''), ' ') AS content, hashes
    FROM (SELECT *, row_number() OVER (PARTITION BY snapshot ORDER BY captured_at, slug, surt) AS rn
          FROM (SELECT *, {d_digest('body')} AS snapshot FROM ({_PAGE_BODIES})) WHERE surt IS NOT NULL)
    WHERE rn = 1""")}


@register("page_index", with_ctes("""
    SELECT snapshot, surt, captured_at, slug, year, title, md5(content) AS content_md5, array_to_string(hashes, ' ') AS hashes
    FROM search_docs""", "search_docs", instead=_PAGE_DOCS))
def page_index(spark, sf):
    """The stored documents of extracted pages, avatar hashes included."""
    return fx.page_docs(spark, sf).select("snapshot", "surt", "captured_at", "slug", "year", "title",
                                          F.md5("content").alias("content_md5"), F.array_join("hashes", " ").alias("hashes"))


_WANTED = "shared2"


@register("page_search", search_oracle("SELECT snapshot, surt, round(score, 6) AS score FROM matches", S_TERMS, instead=_PAGE_DOCS))
def page_search(spark, sf):
    """T4 over the index of extracted pages."""
    docs = fx.page_docs(spark, sf)
    return srch.search_matches(docs, fx.page_postings(spark, sf), Q_TERMS).select(
        "snapshot", "surt", F.round("score", 6).alias("score"))


@register("search_avatar_scored", search_oracle(f"""
    SELECT m.snapshot, m.surt, round(m.score + {_bm25_sql(_idf_sql('h.df', 'h.n'), '1', 'len(d.hashes)', 'h.avgdl')}, 6) AS score
    FROM matches m JOIN search_docs d ON d.snapshot = m.snapshot AND list_contains(d.hashes, md5('{_WANTED}')),
         (SELECT count(*) AS n, avg(len(hashes)) AS avgdl, count(*) FILTER (list_contains(hashes, md5('{_WANTED}'))) AS df
          FROM search_docs) h""", S_TERMS, instead=_PAGE_DOCS))
def search_avatar_scored(spark, sf):
    """T5 with F6: the pages that show an avatar, ranked by text and by the BM25 of the avatar's hash."""
    import hashlib
    q = srch.Query(should=Q_TERMS.should, gravatar_hash=hashlib.md5(_WANTED.encode()).hexdigest(), score_hash=True)
    return srch.search_matches(fx.page_docs(spark, sf), fx.page_postings(spark, sf), q).select(
        "snapshot", "surt", F.round("score", 6).alias("score"))
