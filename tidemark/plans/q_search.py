"""Catalogue part 3: index build, ranked search, filters, facets, grouped top-K, timelines, page results."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import search as srch
from tidemark.plans import fixtures as fx
from tidemark.plans.catalog import register
from tidemark.plans.oracle import q as lit
from tidemark.plans.oracle import with_ctes

# Query parameters of the registered searches (user input, not data).
Q_TERMS = srch.Query(should="nicht dans")
Q_MUST_NOT = srch.Query(must="the", must_not="nicht")
Q_PHRASE = srch.Query(phrase="of the")
Q_FIELD = srch.Query(should="the", fields=("title",))
Q_BOOST = srch.Query(should="sur enou", boosts={"title": 2.0})
Q_FILTERED = srch.Query(should="sur enou dans", slugs=("site1", "site2", "site5"), years=(2016, 2017, 2018, 2019, 2020, 2021),
                        start=datetime(2016, 3, 1), end=datetime(2021, 6, 1))
Q_MUST_SHOULD = srch.Query(must="the", should="of nicht")
Q_OR_PHRASE = srch.Query(should="nicht", phrase="of the")
Q_PHRASES = srch.Query(phrase=("of the", "in the"))
Q_GROUP = srch.Query(group=srch.Group(must=(srch.Group(should=(srch.Words("nicht dans"), srch.Phrase("of the"))),
                                            srch.Words("the und", ("title",)))), must_not="sur")
PAGE = 10


@dataclass(frozen=True)
class Stated:
    """A request as DuckDB reads it, stated apart from the engine: leaves (name, words, fields; several words are a
    phrase), the SQL condition over the names and the score over the names with ``_s``."""
    leaves: tuple
    match: str
    score: str
    where: str = "true"
    boost: str = "1.0::DOUBLE"


_BOTH = ("title", "content")
S_TERMS = Stated((("a", ("nicht",), _BOTH), ("b", ("dans",), _BOTH)), "a OR b", "a_s + b_s")
S_MUST_NOT = Stated((("a", ("the",), _BOTH), ("b", ("nicht",), _BOTH)), "a AND NOT b", "a_s")
S_PHRASE = Stated((("a", ("of", "the"), _BOTH),), "a", "a_s")
S_FIELD = Stated((("a", ("the",), ("title",)),), "a", "a_s")
S_BOOST = Stated((("a", ("sur",), _BOTH), ("b", ("enou",), _BOTH)), "a OR b", "a_s + b_s",
                 boost="CASE WHEN x.field = 'title' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END")
S_FILTERED = Stated((("a", ("sur",), _BOTH), ("b", ("enou",), _BOTH), ("c", ("dans",), _BOTH)), "a OR b OR c",
                    "a_s + b_s + c_s",
                    "slug IN ('site1', 'site2', 'site5') AND year BETWEEN 2016 AND 2021 "
                    "AND captured_at >= TIMESTAMP '2016-03-01 00:00:00' AND captured_at < TIMESTAMP '2021-06-01 00:00:00'")
S_MUST_SHOULD = Stated((("a", ("the",), _BOTH), ("b", ("of",), _BOTH), ("c", ("nicht",), _BOTH)), "a", "a_s + b_s + c_s")
S_OR_PHRASE = Stated((("a", ("nicht",), _BOTH), ("b", ("of", "the"), _BOTH)), "a OR b", "a_s + b_s")
S_PHRASES = Stated((("a", ("of", "the"), _BOTH), ("b", ("in", "the"), _BOTH)), "a OR b", "a_s + b_s")
S_GROUP = Stated((("a", ("nicht",), _BOTH), ("b", ("dans",), _BOTH), ("c", ("of", "the"), _BOTH),
                  ("d", ("the",), ("title",)), ("e", ("und",), ("title",)), ("f", ("sur",), _BOTH)),
                 "(a OR b OR c) AND (d OR e) AND NOT f", "(a_s + b_s + c_s) + (d_s + e_s)")


def _index(spark, sf):
    """The stored index (documents + postings) that scoring, facets and ranking read."""
    docs = fx.search_docs(spark, sf)
    return docs, fx.postings(spark, sf), srch.field_stats(docs)


def _rounded(score: str):
    """A score as the catalogue shows it; ranking uses the exact one."""
    return F.round(score, 6).alias(score)


def _matches(spark, sf, query):
    docs, post, stats = _index(spark, sf)
    return srch.search_matches(docs, post, query, stats)


# ------------------------------------------------------------------ oracle helpers
# Fixed values of the ranking, stated here again: k1, b; and the first year of the year facet.
_K1, _B = "1.2::DOUBLE", "0.75::DOUBLE"
_FIRST_YEAR = 2004


def _bm25_sql(idf: str, tf: str, dl: str, avgdl: str) -> str:
    return f"({idf}) * ({_K1} + 1) * {tf} / ({tf} + {_K1} * ((1 - {_B}) + {_B} * {dl} / {avgdl}))"


def _idf_sql(df: str, n: str) -> str:
    return f"ln(1 + ({n} - {df} + 0.5::DOUBLE) / ({df} + 0.5::DOUBLE))"


def _in(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def matches_ctes(request: Stated) -> tuple[tuple[str, str], ...]:
    """Query-local CTEs ending in ``matches(snapshot, surt, captured_at, slug, year, title, score)``."""
    ctes, leaves = [], []
    for name, words, fields in request.leaves:
        if len(words) == 1:
            ctes.append((f"tf_{name}", f"""SELECT snapshot, field, count(*) AS tf FROM postings
                WHERE token = {lit(words[0])} AND field IN {_in(fields)} GROUP BY ALL"""))
            ctes.append((f"idf_{name}", f"""SELECT x.field, {_idf_sql('count(*)', 'any_value(s.n_docs)')} AS idf
                FROM tf_{name} x JOIN field_stats s ON s.field = x.field GROUP BY x.field"""))
        else:
            follows = " AND ".join(
                f"EXISTS (SELECT 1 FROM postings p{i} WHERE p{i}.snapshot = p0.snapshot AND p{i}.field = p0.field "
                f"AND p{i}.pos = p0.pos + {i} AND p{i}.token = {lit(w)})" for i, w in enumerate(words) if i > 0)
            ctes.append((f"tf_{name}", f"""SELECT p0.snapshot, p0.field, count(*) AS tf FROM postings p0
                WHERE p0.token = {lit(words[0])} AND p0.field IN {_in(fields)} AND {follows} GROUP BY ALL"""))
            per_word = ", ".join(f"({lit(w)}, {words.count(w)})" for w in sorted(set(words)))
            ctes.append((f"idf_{name}", f"""SELECT d.field, list_sum(list_sort(list({_idf_sql('d.df', 's.n_docs')} * k.k))) AS idf
                FROM (SELECT field, token, count(DISTINCT snapshot) AS df FROM postings
                      WHERE token IN {_in(words)} AND field IN {_in(fields)} GROUP BY ALL) d
                JOIN (VALUES {per_word}) k(token, k) ON k.token = d.token
                JOIN field_stats s ON s.field = d.field GROUP BY d.field"""))
        leaves.append(f"""SELECT x.snapshot, x.field, {lit(name)} AS leaf,
                {_bm25_sql('i.idf', 'x.tf', 'fl.dl', 's.avgdl')} * {request.boost} AS score
            FROM tf_{name} x JOIN idf_{name} i ON i.field = x.field JOIN field_stats s ON s.field = x.field
            JOIN field_lengths fl ON fl.snapshot = x.snapshot AND fl.field = x.field""")
    ctes.append(("q_cells", " UNION ALL ".join(leaves)))
    cols = []
    for name, _, _ in request.leaves:
        one = [f"coalesce(max(score) FILTER (leaf = {lit(name)} AND field = {lit(f)}), 0.0::DOUBLE)" for f in _BOTH]
        cols += [f"count(*) FILTER (leaf = {lit(name)}) > 0 AS {name}", f"{one[0]} + {one[1]} AS {name}_s"]
    ctes.append(("q_wide", f"SELECT snapshot, {', '.join(cols)} FROM q_cells GROUP BY snapshot"))
    ctes.append(("matches", f"""SELECT d.snapshot, d.surt, d.captured_at, d.slug, d.year, d.title, {request.score} AS score
        FROM search_docs d JOIN q_wide w ON w.snapshot = d.snapshot WHERE ({request.match}) AND {request.where}"""))
    return tuple(ctes)


_SEARCH_NEEDS = ("search_docs", "postings", "field_lengths", "field_stats")


def search_oracle(body: str, request: Stated, *more: str, extra=(), instead=None) -> str:
    return with_ctes(body, *_SEARCH_NEEDS, *more, extra=matches_ctes(request) + tuple(extra), instead=instead)


# ------------------------------------------------------------------ index build
@register("search_docs", with_ctes("""
    SELECT snapshot, surt, captured_at, slug, year, title, CAST(length(content) AS BIGINT) AS n_chars
    FROM search_docs""", "search_docs"))
def search_docs(spark, sf):
    d = fx.search_docs.build(spark, sf)
    return d.select("snapshot", "surt", "captured_at", "slug", "year", "title",
                    F.length("content").cast("bigint").alias("n_chars"))


@register("tokens", with_ctes("SELECT snapshot, field, pos, token FROM postings", "postings"))
def tokens(spark, sf):
    return srch.postings(fx.search_docs(spark, sf)).select("snapshot", "field", "pos", "token")


@register("tokens_stored", with_ctes("""
    SELECT p.snapshot, p.field, p.pos, p.token, l.dl FROM postings p
    JOIN field_lengths l ON l.snapshot = p.snapshot AND l.field = p.field""", "postings", "field_lengths"))
def tokens_stored(spark, sf):
    """The stored postings per document, seen as one row per occurrence."""
    return srch.occurrences(fx.postings(spark, sf))


@register("collection_stats", with_ctes("""
    SELECT field, token, count(DISTINCT snapshot) AS df, count(*) AS cf FROM postings GROUP BY ALL""", "postings"))
def collection_stats(spark, sf):
    post = fx.postings(spark, sf)
    return srch.collection_stats(post).select("field", "token", "df", F.col("cf").cast("bigint").alias("cf"))


@register("field_stats", with_ctes("SELECT field, n_docs, round(avgdl, 6) AS avgdl FROM field_stats", "field_stats"))
def field_stats_q(spark, sf):
    docs = fx.search_docs(spark, sf)
    st = srch.field_stats(docs)
    return (fx.postings(spark, sf).select("field").distinct()
            .select("field", st["n"].alias("n_docs"),
                    F.round(F.when(F.col("field") == "title", st["title"]).otherwise(st["content"]), 6).alias("avgdl")))


# ------------------------------------------------------------------ ranked queries
def _match_query(name, query, stated):
    @register(name, search_oracle("SELECT snapshot, surt, round(score, 6) AS score FROM matches", stated))
    def run(spark, sf):
        return _matches(spark, sf, query).select("snapshot", "surt", _rounded("score"))
    run.__name__ = name
    return run


search_terms = _match_query("search_terms", Q_TERMS, S_TERMS)
search_must_not = _match_query("search_must_not", Q_MUST_NOT, S_MUST_NOT)
search_phrase = _match_query("search_phrase", Q_PHRASE, S_PHRASE)
search_field = _match_query("search_field", Q_FIELD, S_FIELD)
search_boost = _match_query("search_boost", Q_BOOST, S_BOOST)
search_filtered = _match_query("search_filtered", Q_FILTERED, S_FILTERED)
search_must_should = _match_query("search_must_should", Q_MUST_SHOULD, S_MUST_SHOULD)
search_or_phrase = _match_query("search_or_phrase", Q_OR_PHRASE, S_OR_PHRASE)
search_phrases = _match_query("search_phrases", Q_PHRASES, S_PHRASES)
search_group = _match_query("search_group", Q_GROUP, S_GROUP)


# ------------------------------------------------------------------ facets
@register("facet_patterns", search_oracle("""
    SELECT coalesce(p.slug, c.slug) AS slug, p.sort_id AS sort_key, CAST(coalesce(c.n, 0) AS BIGINT) AS n
    FROM patterns p FULL JOIN (SELECT slug, count(*) AS n FROM matches GROUP BY slug) c ON c.slug = p.slug""",
                                    S_TERMS, "patterns"))
def facet_patterns(spark, sf):
    return srch.facet_patterns(_matches(spark, sf, Q_TERMS), fx.patterns(spark, sf))


@register("facet_years", search_oracle(f"""
    SELECT CAST(coalesce(y.year, c.year) AS INTEGER) AS year, CAST(coalesce(c.n, 0) AS BIGINT) AS n
    FROM (SELECT unnest(range((SELECT max(year) FROM search_docs), {_FIRST_YEAR - 1}, -1)) AS year) y
    FULL JOIN (SELECT year, count(*) AS n FROM matches GROUP BY year) c ON c.year = y.year""", S_TERMS))
def facet_years(spark, sf):
    docs, post, stats = _index(spark, sf)
    last = docs.agg(F.max("year")).scalar()
    return srch.facet_years(srch.search_matches(docs, post, Q_TERMS, stats), last)


@register("search_total", search_oracle(f"""
    SELECT CAST(count(*) AS BIGINT) AS total, CAST(ceil(count(*) / {PAGE}) AS BIGINT) AS pages FROM matches""", S_TERMS))
def search_total(spark, sf):
    return srch.search_total(srch.facet_patterns(_matches(spark, sf, Q_TERMS), fx.patterns(spark, sf)), PAGE)


# ------------------------------------------------------------------ grouped top-K, hits, timelines
_TOP_CTES = (
    ("q_best", "SELECT surt, max(score) AS best, count(*) AS n_hits FROM matches GROUP BY surt"),
    ("q_ranked", "SELECT *, row_number() OVER (ORDER BY best DESC, surt) AS rank FROM q_best"),
)


def _top_sql(offset: int) -> tuple[tuple[str, str], ...]:
    return _TOP_CTES + (("q_top", f"SELECT * FROM q_ranked WHERE rank > {offset} AND rank <= {offset + PAGE}"),)


@register("top_surts", search_oracle("SELECT rank, surt, round(best, 6) AS best, n_hits FROM q_top", S_TERMS, extra=_top_sql(0)))
def top_surts(spark, sf):
    return srch.top_surts(_matches(spark, sf, Q_TERMS), PAGE, 0).select("rank", "surt", _rounded("best"), "n_hits")


@register("top_surts_page2", search_oracle("SELECT rank, surt, round(best, 6) AS best, n_hits FROM q_top", S_TERMS, extra=_top_sql(PAGE)))
def top_surts_page2(spark, sf):
    return srch.top_surts(_matches(spark, sf, Q_TERMS), PAGE, PAGE).select("rank", "surt", _rounded("best"), "n_hits")


def _ranked(spark, sf):
    m = _matches(spark, sf, Q_TERMS)
    top = srch.top_surts(m, PAGE, 0)
    return m, top, srch.group_hits(m, top)


PAGE_CTES = _top_sql(0) + (
    ("q_hits", "SELECT m.*, t.rank, t.best FROM matches m JOIN q_top t ON t.surt = m.surt"),
    ("q_caps", """SELECT h.rank, s.surt, s.captured_at, s.snapshot, h.score FROM success s
                  JOIN q_hits h ON h.snapshot = s.snapshot AND h.surt = s.surt"""),
    ("q_timeline", "SELECT DISTINCT s.surt, s.captured_at, t.rank FROM success s JOIN q_top t ON t.surt = s.surt"),
    ("q_tl_hits", """SELECT coalesce(t.rank, h.rank) AS rank, coalesce(t.surt, h.surt) AS surt,
                            coalesce(t.captured_at, h.captured_at) AS captured_at, h.score
                     FROM q_timeline t FULL JOIN (SELECT rank, surt, captured_at, max(score) AS score FROM q_caps GROUP BY ALL) h
                       ON h.rank = t.rank AND h.surt = t.surt AND h.captured_at = t.captured_at"""),
    ("q_titles", """SELECT surt, title, n FROM (SELECT surt, title, n,
                       row_number() OVER (PARTITION BY surt ORDER BY n DESC, title) AS rn
                     FROM (SELECT surt, title, count(*) AS n FROM q_hits GROUP BY ALL)) WHERE rn = 1"""),
)


@register("hit_captures", search_oracle("SELECT rank, surt, captured_at, snapshot, round(score, 6) AS score FROM q_caps", S_TERMS, "success",
                                  extra=PAGE_CTES))
def hit_captures(spark, sf):
    _, _, hits = _ranked(spark, sf)
    return srch.hit_captures(hits, fx.success(spark, sf)).withColumn("score", _rounded("score"))


@register("surt_timeline", search_oracle("SELECT rank, surt, captured_at FROM q_timeline", S_TERMS, "success", extra=PAGE_CTES))
def surt_timeline(spark, sf):
    _, top, _ = _ranked(spark, sf)
    return srch.surt_timeline(top, fx.success(spark, sf)).select("rank", "surt", "captured_at")


@register("timeline_hits", search_oracle("SELECT rank, surt, captured_at, round(score, 6) AS score FROM q_tl_hits", S_TERMS, "success",
                                   extra=PAGE_CTES))
def timeline_hits(spark, sf):
    _, top, hits = _ranked(spark, sf)
    succ = fx.success(spark, sf)
    return (srch.timeline_hits(srch.surt_timeline(top, succ), srch.hit_captures(hits, succ))
            .withColumn("score", _rounded("score")))


@register("page_titles", search_oracle("SELECT surt, title, n FROM q_titles", S_TERMS, "success", extra=PAGE_CTES))
def page_titles(spark, sf):
    _, _, hits = _ranked(spark, sf)
    return srch.page_titles(hits).select("surt", "title", "n")


@register("page_results", search_oracle("""
    SELECT t.rank, t.surt,
           'https://' || array_to_string(list_reverse(string_split(split_part(t.surt, ')', 1), ',')), '.')
             || substr(t.surt, length(split_part(t.surt, ')', 1)) + 2) AS canonical_url,
           ti.title, round(t.best, 6) AS score, t.n_hits, coalesce(tl.n_captures, 0) AS n_captures,
           coalesce(tl.n_hit_captures, 0) AS n_hit_captures, tl.first_capture, tl.last_capture,
           'https://web.archive.org/web/' || strftime(nw.newest, '%Y%m%d%H%M%S') || '/' || 'https://'
             || array_to_string(list_reverse(string_split(split_part(t.surt, ')', 1), ',')), '.')
             || substr(t.surt, length(split_part(t.surt, ')', 1)) + 2) AS newest_url
    FROM q_top t JOIN q_titles ti ON ti.surt = t.surt
    JOIN (SELECT surt, max(captured_at) AS newest FROM q_hits GROUP BY surt) nw ON nw.surt = t.surt
    LEFT JOIN (SELECT surt, count(*) AS n_captures, count(score) AS n_hit_captures, min(captured_at) AS first_capture,
                      max(captured_at) AS last_capture
               FROM q_tl_hits GROUP BY surt) tl ON tl.surt = t.surt""", S_TERMS, "success", extra=PAGE_CTES))
def page_results(spark, sf):
    """One search request through ``search.search``; its page rows."""
    docs, post, _ = _index(spark, sf)
    res = srch.search(docs, post, fx.success(spark, sf), fx.patterns(spark, sf), Q_TERMS, limit=PAGE, offset=0)
    return res.pages.withColumn("score", _rounded("score"))


@register("index_counts", with_ctes("""
    SELECT count(*) AS documents, count(DISTINCT surt) AS surts, count(DISTINCT slug) AS collections,
           (SELECT count(*) FROM postings) AS postings
    FROM search_docs""", "search_docs", "postings"))
def index_counts(spark, sf):
    """Documents indexed, distinct URL keys and collections among them, postings written."""
    docs = fx.search_docs(spark, sf)
    n_post = fx.postings(spark, sf).select(F.sum("tf")).scalar()
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("surt").alias("surts"),
                    F.countDistinct("slug").alias("collections"), n_post.alias("postings"))
