"""Full-text search as Spark jobs: document table, positional postings, BM25 scoring, facets, grouped top-K,
per-URL timelines and page assembly (T2-T9, E2, E3, E6, E8, E12-E14, K1, K2, J3, J4, J11).

Layout at scale: ``docs`` (one row per snapshot) and postings (one row per document, field and token, with the array of
positions and the field length) are written once, postings in folders by token. A query reads the postings of its
handful of terms (folders and row groups of others are skipped), joins the tiny per-term document-frequency table by
broadcast (bounded by fields x terms), and lays the BM25 scores of all terms and phrases out as columns per doc, over
which nested AND / OR / NOT clauses are one expression. Collection statistics (N, mean field length) are
scalar subqueries. Top-K keeps offset+limit groups per task before the final merge; everything after top-K joins a
list bounded by ``limit``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import archive_url, capture_year, raw_tokens, surt_canonical_url
from tidemark.functions.timefmt import utc_bound
from tidemark.functions.text import BM25_B, BM25_K1, FIRST_FACET_YEAR, MAX_TOKEN_BYTES, TOKEN_PATTERN, spaced_tokens
from tidemark.operators.dedup import first_by
from tidemark.operators.reconcile import representative
from tidemark.session import cut_lineage

FIELDS = ("title", "content")
_TOKEN_RE = regex.compile(TOKEN_PATTERN)


def analyse_text(text: str) -> list[str]:
    """Query-side analyser (same rules as the index): letter/digit runs under 40 bytes, lower-cased."""
    return [t.lower() for t in _TOKEN_RE.findall(text or "") if len(t.encode()) < MAX_TOKEN_BYTES]


@dataclass(frozen=True)
class Words:
    """Any of the words of ``text``, in ``fields`` (None: those of the query)."""
    text: str
    fields: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Phrase:
    """The words of ``text`` at consecutive positions of one field."""
    text: str
    fields: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Group:
    """Every ``must`` clause, or any ``should`` clause where there is no ``must``, and no ``must_not`` clause. Clauses are
    Words, Phrases or Groups; a clause without words is left out, a group of only ``must_not`` matches nothing."""
    should: tuple = ()
    must: tuple = ()
    must_not: tuple = ()


@dataclass
class Query:
    """Structured form of a search request (T4/T5/T9). Words are analysed like the index."""
    should: str = ""                      # default OR terms
    must: str = ""                        # every term required (+term)
    must_not: str = ""                    # no term allowed (-term)
    phrase: str | tuple[str, ...] = ""    # consecutive terms ("..."), each phrase another OR clause
    group: Group | None = None            # nested clauses, one more OR clause
    fields: tuple[str, ...] = FIELDS      # field:term restriction
    boosts: dict[str, float] = field(default_factory=dict)
    slugs: tuple[str, ...] | None = None  # F4 (empty = no filter)
    years: tuple[int, ...] | None = None  # F5
    start: datetime | None = None         # F3 half-open [start, end)
    end: datetime | None = None
    gravatar_hash: str | None = None      # F6
    score_hash: bool = False              # T5: the hash also adds its BM25 to the score

    def tree(self) -> Group:
        """All clauses as one group."""
        phrases = (self.phrase,) if isinstance(self.phrase, str) else tuple(self.phrase)
        return Group(should=(Words(self.should), *map(Phrase, phrases), *((self.group,) if self.group else ())),
                     must=tuple(Words(w) for w in sorted(set(analyse_text(self.must)))),
                     must_not=(Words(self.must_not),))

    def positive_words(self) -> list[str]:
        """Words that a hit may show highlighted."""
        def walk(node):
            if isinstance(node, Group):
                return {w for n in (*node.should, *node.must) for w in walk(n)}
            return set(analyse_text(node.text))
        return sorted(walk(self.tree()))


# ------------------------------------------------------------------ index build
def build_docs(info: DataFrame, bodies: DataFrame, title: Column, content: Column,
               hashes: Column | None = None) -> DataFrame:
    """One document per snapshot from its representative capture (E5), joined to its body.
    ``bodies`` has (digest, body, ...); ``title`` / ``content`` / ``hashes`` are expressions over it."""
    rep = representative(info)
    b = bodies.select(F.col("digest").alias("snapshot"), title.alias("title"), content.alias("content"),
                      (hashes if hashes is not None else F.array().cast("array<string>")).alias("hashes"))
    return (rep.join(b, "snapshot")
            .select("snapshot", "surt", "captured_at", "slug", capture_year("captured_at").alias("year"),
                    "title", "content", "hashes"))


def postings(docs: DataFrame, fields=FIELDS) -> DataFrame:
    """(snapshot, field, pos, token, dl). Positions count every letter/digit run (dropped long tokens leave a
    gap); ``dl`` is the field length in kept tokens."""
    # one scan for all fields; the field length is computed once per document and field, before the explode (after it,
    # it would be re-evaluated for every token row over the whole array)
    kept = F.filter("s.toks", lambda t: F.octet_length(t) < MAX_TOKEN_BYTES)
    per_field = (docs.select("snapshot", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), raw_tokens(F.col(f)).alias("toks")) for f in fields])).alias("s"))
        .select("snapshot", "s.field", F.size(kept).cast("bigint").alias("dl"), F.col("s.toks").alias("toks")))
    return (per_field.select("snapshot", "field", "dl", F.posexplode("toks").alias("pos", "token"))
            .where(F.octet_length("token") < MAX_TOKEN_BYTES)
            .select("snapshot", "field", F.col("pos").cast("bigint").alias("pos"), F.lower("token").alias("token"), "dl"))


STORED = "snapshot string, field string, token string, tf long, dl long, positions array<int>"


def document_postings(docs: DataFrame, fields=FIELDS) -> DataFrame:
    """T3 as it is stored: one row (snapshot, field, token, tf, dl, positions) per document, field and token.

    Texts are dealt out evenly, so that a task's postings fit its memory, and tokenised once, by the analyser's
    expressions on the whole text; the tokens of a batch of documents are then grouped by sorting their dictionary codes
    (Arrow arrays, no loop over rows), so no posting is shuffled or aggregated."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    texts = docs.select("snapshot", *fields).repartition(n, "snapshot").select("snapshot", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), spaced_tokens(F.col(f)).alias("spaced")) for f in fields])).alias("s"))
    # no letter's lower case depends on letters beyond a space
    both = texts.select("snapshot", "s.field", "s.spaced", F.lower("s.spaced").alias("lowered"))
    return both.mapInArrow(_group_texts, STORED)


def _group_texts(batches):
    return _group_tokens(_token_lists(batches))


def _token_lists(batches):
    """(snapshot, field, spaced, lowered) rows to (snapshot, field, toks) rows, dropped tokens null: lower-cased tokens,
    kept by the bytes they had before."""
    for b in (whole.slice(at, TEXTS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, TEXTS_AT_ONCE)):
        spaced, lowered = (pc.split_pattern(b.column(k), " ") for k in (2, 3))
        own = spaced.flatten()
        size = pc.binary_length(own)        # 0: the one piece of a text without tokens
        kept = pc.and_(pc.greater(size, 0), pc.less(size, MAX_TOKEN_BYTES))
        toks = pc.if_else(kept, lowered.flatten(), pa.scalar(None, own.type))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), type(spaced).from_arrays(spaced.offsets, toks)],
                                         names=["snapshot", "field", "toks"])


#: Texts whose tokens are grouped at a time.
TEXTS_AT_ONCE = 256


def _group_tokens(batches):
    """(snapshot, field, toks) rows, dropped tokens null, to one row per row and distinct token. A batch is grouped in
    parts, so a worker's memory does not follow the number of rows in it."""
    for b in (whole.slice(at, TEXTS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, TEXTS_AT_ONCE)):
        toks = b.column(2)
        flat = toks.flatten()
        n = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        coded = flat.dictionary_encode()
        code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        held = np.flatnonzero(code >= 0)
        row, pos, code = row[held], pos[held], code[held]
        key = row * (len(coded.dictionary) + 1) + code
        order = np.argsort(key, kind="stable")             # positions stay ascending within a token
        key, row, code = key[order], row[order], code[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        tf = np.diff(np.r_[starts, len(key)])
        dl = np.bincount(row, minlength=len(n))
        own = pa.array(row[starts])
        positions = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(key)].astype(np.int32)), pa.array(pos[order].astype(np.int32)))
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(own), b.column(1).take(own), coded.dictionary.take(pa.array(code[starts])), pa.array(tf.astype(np.int64)),
             pa.array(dl[row[starts]].astype(np.int64)), positions], names=["snapshot", "field", "token", "tf", "dl", "positions"])


def occurrences(post: DataFrame) -> DataFrame:
    """Stored postings as one row (snapshot, field, pos, token, dl) per occurrence."""
    return (post.select("snapshot", "field", "token", "dl", F.explode("positions").alias("pos"))
            .select("snapshot", "field", F.col("pos").cast("bigint").alias("pos"), "token", "dl"))


def by_document(post: DataFrame) -> DataFrame:
    """Postings per document; rows per occurrence (``postings``) are put together."""
    if "positions" in post.columns:
        return post
    return (post.groupBy("snapshot", "field", "token", "dl")
            .agg(F.sort_array(F.collect_list(F.col("pos").cast("int"))).alias("positions"))
            .withColumn("tf", F.size("positions").cast("bigint")))


#: Folders that stored postings are dealt into by their token.
SHARDS = 16


def _shard(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(SHARDS)).cast("int")


#: Bytes that a column's dictionary may have in a file of postings.
DICTIONARY_BYTES = 8 << 20


def write_postings(post: DataFrame, path: str) -> None:
    """Inverted-index layout: folders by a hash of the token (a query opens those of its terms), sorted by token inside a
    file (row groups of other tokens are skipped). Postings take many times the space of their texts, so they are not
    shuffled: each task sorts those of its documents and adds a file to every folder. A file's dictionary holds all its
    documents, so a snapshot costs a few bits per posting."""
    (post.withColumn("shard", _shard(F.col("token")))
     .sortWithinPartitions("shard", "token", "snapshot", "field")
     .write.mode("overwrite").option("compression", "zstd").option("parquet.dictionary.page.size", DICTIONARY_BYTES)
     .partitionBy("shard").parquet(path))


def of_tokens(post: DataFrame, tokens: list[str]) -> DataFrame:
    """Postings per document of the given tokens; in the stored layout only their folders are opened."""
    rows = by_document(post).where(F.col("token").isin(tokens))
    if "shard" in post.columns:
        rows = rows.where(F.col("shard").isin(*[_shard(F.lit(t)) for t in tokens]))     # folded to numbers
    return rows


def with_field_lengths(docs: DataFrame, fields=FIELDS) -> DataFrame:
    """Index-build step: per document the kept-token count of each field (``<field>_dl``), so collection
    statistics never re-tokenise the corpus at query time."""
    return docs.select("*", *[F.size(F.filter(raw_tokens(F.col(f)), lambda t: F.octet_length(t) < MAX_TOKEN_BYTES))
                              .cast("bigint").alias(f"{f}_dl") for f in fields])


def field_stats(docs: DataFrame) -> dict[str, Column]:
    """Number of documents and mean field length, as ONE struct-valued scalar subquery (no driver round trip).
    Uses the stored ``<field>_dl`` columns when present."""
    if not all(f"{f}_dl" in docs.columns for f in FIELDS):
        docs = with_field_lengths(docs)
    agg = docs.agg(F.struct(F.count(F.lit(1)).alias("n"), *[F.avg(f"{f}_dl").alias(f) for f in FIELDS]).alias("s"))
    s = agg.select("s").scalar()
    out = {"n": s["n"]}
    for f in FIELDS:
        out[f] = s[f]
    return out


def collection_stats(post: DataFrame) -> DataFrame:
    """Document frequency and total term frequency per (field, token)."""
    return by_document(post).groupBy("field", "token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _avgdl(stats: dict[str, Column]) -> Column:
    c = F.when(F.col("field") == FIELDS[0], stats[FIELDS[0]])
    for f in FIELDS[1:]:
        c = c.when(F.col("field") == f, stats[f])
    return c


def _idf(df: Column, n: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def _bm25(idf: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    norm = F.lit(BM25_K1) * (F.lit(1 - BM25_B) + F.lit(BM25_B) * dl / avgdl)
    return idf * F.lit(BM25_K1 + 1) * tf / (tf + norm)


def _boost(boosts: dict[str, float]) -> Column:
    c = F.lit(1.0)
    for f, b in boosts.items():
        c = F.when(F.col("field") == f, F.lit(float(b))).otherwise(c)
    return c


def term_scores(post: DataFrame, stats: dict[str, Column], terms: list[str], fields=FIELDS,
                boosts: dict[str, float] | None = None) -> DataFrame:
    """(snapshot, clause, field, score): BM25 of each term in each searched field."""
    tf = of_tokens(post, terms).where(F.col("field").isin(list(fields))).select("snapshot", "field", "token", "tf", "dl")
    # at most len(fields) x len(terms) rows: a proven bound, so broadcast
    dfs = tf.groupBy("field", "token").agg(F.count(F.lit(1)).alias("df"))
    s = tf.join(F.broadcast(dfs), ["field", "token"])
    sc = _bm25(_idf(F.col("df"), stats["n"]), F.col("tf"), F.col("dl"), _avgdl(stats)) * _boost(boosts or {})
    return s.select("snapshot", F.col("token").alias("clause"), "field", sc.alias("score"))


def _shifted(by: int):
    return lambda x: x - by


def phrase_scores(post: DataFrame, stats: dict[str, Column], words: list[str], fields=FIELDS,
                  boosts: dict[str, float] | None = None) -> DataFrame:
    """(snapshot, clause, field, score) of a phrase: consecutive positions in one field. The position arrays of its words
    meet per document and field, are shifted by the words' places and intersected; BM25 with phrase frequency and the sum
    of term idfs. The clause is the words joined by a space."""
    flt = of_tokens(post, sorted(set(words))).where(F.col("field").isin(list(fields)))
    cell = {w: f"w{k}" for k, w in enumerate(sorted(set(words)))}
    # one row per document and field, at most one array per word
    met = flt.groupBy("snapshot", "field", "dl").agg(*[
        F.max(F.when(F.col("token") == w, F.col("positions"))).alias(c) for w, c in cell.items()])
    starts = F.col(cell[words[0]])
    for i, w in enumerate(words[1:], 1):
        starts = F.array_intersect(starts, F.transform(cell[w], _shifted(i)))
    pf = (met.where(F.expr(" AND ".join(f"{c} IS NOT NULL" for c in cell.values())))
          .select("snapshot", "field", "dl", F.size(starts).cast("bigint").alias("pf")).where("pf > 0"))
    dfs = flt.groupBy("field", "token").agg(F.count(F.lit(1)).alias("df"))
    # a word repeated in the phrase contributes its idf once per occurrence
    k = F.lit(0)
    for w in set(words):
        k = F.when(F.col("token") == w, F.lit(words.count(w))).otherwise(k)
    # added in a fixed order (at most one value per word), so equal hits get equal scores in every run
    idfs = F.sort_array(F.collect_list("idf"))
    idf_sum = (dfs.select("field", (_idf(F.col("df"), stats["n"]) * k).alias("idf"))
               .groupBy("field").agg(F.aggregate(idfs, F.lit(0.0), lambda a, x: a + x).alias("idf_sum")))
    # at most len(fields) rows
    s = pf.join(F.broadcast(idf_sum), "field")
    sc = _bm25(F.col("idf_sum"), F.col("pf"), F.col("dl"), _avgdl(stats)) * _boost(boosts or {})
    return s.select("snapshot", F.lit(" ".join(words)).alias("clause"), "field", sc.alias("score"))


def _leaves(node, fields: tuple[str, ...]) -> set[tuple[str, str]]:
    """(clause, field) of all terms and phrases below ``node``."""
    if isinstance(node, Group):
        return {leaf for n in (*node.should, *node.must, *node.must_not) for leaf in _leaves(n, fields)}
    words = analyse_text(node.text)
    clauses = [" ".join(words)] if isinstance(node, Phrase) and words else words
    return {(c, f) for c in clauses for f in (node.fields or fields)}


def _evaluate(node, fields: tuple[str, ...], cell: dict[tuple[str, str], str]) -> tuple[Column, Column] | None:
    """(matches, score) of a clause over the columns that hold its leaves' scores (null: no match); None without
    words. Scores are added in the order of the clauses and fields."""
    if not isinstance(node, Group):
        words = analyse_text(node.text)
        clauses = ([" ".join(words)] if isinstance(node, Phrase) else list(dict.fromkeys(words))) if words else []
        cols = [F.col(cell[c, f]) for c in clauses for f in (node.fields or fields)]
        if not cols:
            return None
        return F.coalesce(*cols).isNotNull(), sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    should, must, must_not = ([e for n in part if (e := _evaluate(n, fields, cell)) is not None]
                              for part in (node.should, node.must, node.must_not))
    if not should and not must:
        return (F.lit(False), F.lit(0.0)) if must_not else None
    match = F.lit(bool(must))
    for m, _ in must or should:
        match = match & m if must else match | m
    for m, _ in must_not:
        match = match & ~m
    return match, sum((F.when(m, s).otherwise(0.0) for m, s in (*must, *should)), F.lit(0.0))


def filter_docs(docs: DataFrame, q: Query) -> DataFrame:
    """T5 filters on the document table (F3-F6); empty sets mean no filter."""
    d = docs
    if q.slugs:
        d = d.where(F.col("slug").isin(list(q.slugs)))
    if q.years:
        d = d.where(F.col("year").isin(list(q.years)))
    if q.start is not None:
        d = d.where(F.col("captured_at") >= utc_bound(q.start))
    if q.end is not None:
        d = d.where(F.col("captured_at") < utc_bound(q.end))
    if q.gravatar_hash:
        d = d.where(F.array_contains("hashes", q.gravatar_hash))
    return d


def hash_score(docs: DataFrame, wanted: str) -> Column:
    """T5: BM25 of an avatar hash in the field of hashes (a document holds each of its hashes once). Statistics, of the
    whole collection, are one scalar subquery."""
    s = docs.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg(F.size("hashes")).alias("avgdl"),
                          F.count_if(F.array_contains("hashes", wanted)).alias("df")).alias("s")).scalar()
    return _bm25(_idf(s["df"], s["n"]), F.lit(1.0), F.size("hashes"), s["avgdl"])


def search_matches(docs: DataFrame, post: DataFrame, q: Query, stats: dict[str, Column] | None = None) -> DataFrame:
    """T4 + T5: (snapshot, surt, captured_at, slug, year, title, score) for every matching document. Statistics
    come from the unfiltered collection."""
    stats = stats or field_stats(docs)
    tree = q.tree()
    leaves = sorted(_leaves(tree, q.fields))
    cell = {leaf: f"s{k}" for k, leaf in enumerate(leaves)}
    found = _evaluate(tree, q.fields, cell)
    out = ("snapshot", "surt", "captured_at", "slug", "year", "title")
    if found is None:
        return docs.limit(0).select(*out, F.lit(0.0).alias("score"))
    fields = sorted({f for _, f in leaves})
    terms = sorted({c for c, _ in leaves if " " not in c})
    parts = [term_scores(post, stats, terms, fields, q.boosts)] if terms else []
    parts += [phrase_scores(post, stats, c.split(" "), fields, q.boosts) for c in sorted({c for c, _ in leaves if " " in c})]
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p)
    # one row per snapshot, one column per leaf: the clauses are then plain expressions
    wide = scores.groupBy("snapshot").agg(*[
        F.max(F.when((F.col("clause") == c) & (F.col("field") == f), F.col("score"))).alias(name)
        for (c, f), name in cell.items()])
    match, score = found
    scored = wide.where(match).select("snapshot", score.alias("score"))
    if not (q.gravatar_hash and q.score_hash):
        return filter_docs(docs, q).select(*out).join(scored, "snapshot")
    added = hash_score(docs, q.gravatar_hash).alias("added")
    return (filter_docs(docs, q).select(*out, added).join(scored, "snapshot")
            .select(*out, (F.col("score") + F.col("added")).alias("score")))


# ------------------------------------------------------------------ facets
def facet_patterns(matches: DataFrame, patterns: DataFrame) -> DataFrame:
    """Matches per collection; every configured collection appears (0 when none) in display order, unknown
    slugs follow (sort_key NULL)."""
    counts = matches.groupBy("slug").agg(F.count(F.lit(1)).alias("n"))
    p = patterns.select("slug", "sort_id")
    return (p.join(counts, "slug", "full")
            .select("slug", F.col("sort_id").alias("sort_key"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def facet_years(matches: DataFrame, last_year: Column | int, first_year: int = FIRST_FACET_YEAR) -> DataFrame:
    """Matches per capture year, years last_year down to first_year seeded with 0, others appended."""
    spark = matches.sparkSession
    ly = last_year if isinstance(last_year, Column) else F.lit(last_year)
    seed = spark.range(1).select(F.explode(F.sequence(ly.cast("int"), F.lit(first_year), F.lit(-1))).alias("year"))
    counts = matches.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    return (seed.join(counts, "year", "full")
            .select(F.col("year").cast("int").alias("year"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def search_total(facets: DataFrame, per_page: int) -> DataFrame:
    """total = sum of collection facet counts; pages = ceil(total / per_page)."""
    return facets.agg(F.sum("n").cast("bigint").alias("total")).select(
        "total", F.ceil(F.col("total") / F.lit(per_page)).cast("bigint").alias("pages"))


# ------------------------------------------------------------------ grouping, ranking, timelines
def top_surts(matches: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """E6 + K1: SURT groups ranked by best hit score (ties by SURT), page [offset, offset+limit). Each task keeps
    offset+limit candidates (TakeOrderedAndProject); the rank is numbered on that bounded list only."""
    best = matches.groupBy("surt").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("n_hits"))
    head = best.orderBy(F.desc("best"), F.asc("surt")).limit(offset + limit)
    w = Window.orderBy(F.desc("best"), F.asc("surt"))  # over <= offset+limit rows
    return head.withColumn("rank", F.row_number().over(w)).where(F.col("rank") > offset)


def group_hits(matches: DataFrame, top: DataFrame) -> DataFrame:
    """K2: hits of the ranked SURTs (top is bounded by limit: broadcast)."""
    return matches.join(F.broadcast(top.select("surt", "rank", "best")), "surt")


def hit_captures(hits: DataFrame, success: DataFrame, expand_duplicates: bool = False,
                 surts: list[str] | None = None) -> DataFrame:
    """Captures that hold a hit's body. By default only captures of the ranked SURT (D4); with
    ``expand_duplicates`` every capture of the same body, under any SURT. ``surts``: the ranked SURTs, where known
    (a page's, so bounded), as a filter of the scan."""
    s = success.select("snapshot", "surt", "captured_at")
    if surts is not None and not expand_duplicates:
        s = s.where(F.col("surt").isin(surts))
    h = hits.select("snapshot", F.col("surt").alias("hit_surt"), "score", "rank")
    j = s.join(h, "snapshot")
    if not expand_duplicates:
        j = j.where(F.col("surt") == F.col("hit_surt"))
    return j.select("rank", "surt", "captured_at", "snapshot", "score")


def surt_timeline(top: DataFrame, success: DataFrame, start=None, end=None, surts: list[str] | None = None) -> DataFrame:
    """All fetched capture instants of the ranked SURTs, optionally in [start, end). ``surts``: the ranked SURTs,
    where known, as a filter of the scan (a table sorted by SURT skips all other row groups)."""
    s = success.select("surt", "captured_at")
    if surts is not None:
        s = s.where(F.col("surt").isin(surts))
    if start is not None:
        s = s.where(F.col("captured_at") >= utc_bound(start))
    if end is not None:
        s = s.where(F.col("captured_at") < utc_bound(end))
    return s.join(F.broadcast(top.select("surt", "rank")), "surt").distinct()


def timeline_hits(timeline: DataFrame, caps: DataFrame) -> DataFrame:
    """J11 + E12: each timeline instant with the best hit score at that instant (NULL when not a hit); hit
    captures outside the timeline are kept (full join)."""
    hit = caps.groupBy("rank", "surt", "captured_at").agg(F.max("score").alias("score"))
    return timeline.join(hit, ["rank", "surt", "captured_at"], "full").select("rank", "surt", "captured_at", "score")


def page_titles(hits: DataFrame) -> DataFrame:
    """Modal title of each ranked SURT's hits (ties: smallest title)."""
    n = hits.groupBy("surt", "title").agg(F.count(F.lit(1)).alias("n"))
    return first_by(n, ["surt"], [F.negative("n"), F.col("title")], ["title", "n"])


def page_results(top: DataFrame, hits: DataFrame, tl: DataFrame) -> DataFrame:
    """One row per ranked SURT: canonical URL, modal title, best score, hit count, the newest hit's replay URL
    and timeline aggregates (instants, hit instants, first / last capture). The timeline itself stays one row per
    instant (``timeline_hits``): a popular SURT can own a large share of all captures, so it is never collected
    into a single row."""
    titles = page_titles(hits).select("surt", "title")
    newest = first_by(hits.select("surt", "captured_at", "snapshot"), ["surt"],
                      [F.negative(F.unix_micros("captured_at")), F.col("snapshot")], ["captured_at"])
    tls = (tl.groupBy("surt")
           .agg(F.count(F.lit(1)).alias("n_captures"), F.count("score").alias("n_hit_captures"),
                F.min("captured_at").alias("first_capture"), F.max("captured_at").alias("last_capture")))
    return (top.join(titles, "surt").join(newest.withColumnRenamed("captured_at", "newest"), "surt")
            .join(tls, "surt", "left")
            .select("rank", "surt", surt_canonical_url("surt").alias("canonical_url"), "title",
                    F.col("best").alias("score"), "n_hits", F.coalesce("n_captures", F.lit(0)).alias("n_captures"),
                    F.coalesce("n_hit_captures", F.lit(0)).alias("n_hit_captures"), "first_capture", "last_capture",
                    archive_url(surt_canonical_url("surt"), F.col("newest")).alias("newest_url")))


def page_hits(hits: DataFrame, docs: DataFrame, query: Query, snippet_chars: int = 200) -> DataFrame:
    """The hits of a page's SURTs: (rank, surt, title of the page, snapshot, captured_at, score, archive_url, snippet).
    Contents are read for the ranked hits only."""
    from tidemark.operators.snippet import snippets
    texts = docs.select("snapshot", "content").join(hits.select("snapshot"), "snapshot", "left_semi")
    marked = snippets(texts, query, snippet_chars)
    own = hits.select("rank", "surt", "snapshot", "captured_at", "score")
    return (own.join(page_titles(hits).select("surt", "title"), "surt").join(marked, "snapshot")
            .select("rank", "surt", "title", "snapshot", "captured_at", "score",
                    archive_url(surt_canonical_url("surt"), F.col("captured_at")).alias("archive_url"), "snippet"))


@dataclass
class SearchResult:
    """T7/T9 result: lazy DataFrames sharing one match set."""
    matches: DataFrame
    collection_facets: DataFrame
    year_facets: DataFrame
    total: DataFrame
    top: DataFrame
    hits: DataFrame
    timeline: DataFrame
    pages: DataFrame
    page_hits: DataFrame


def search(docs: DataFrame, post: DataFrame, success: DataFrame, patterns: DataFrame, query: Query,
           limit: int = 10, offset: int = 0, last_year: Column | int | None = None,
           expand_duplicates: bool = False, snippet_chars: int = 200) -> SearchResult:
    """T7 + T9: one search request. The match set feeds facets (counted over every match, honouring all filters:
    D5), the grouped top-K page, hit captures, timelines (restricted to the query's date range) and page rows; it
    and the ranked page are written once (reliable checkpoint) and read by every output."""
    stats = field_stats(docs)
    m = cut_lineage(search_matches(docs, post, query, stats))
    ly = last_year if last_year is not None else docs.agg(F.max("year")).scalar()
    facets = facet_patterns(m, patterns)
    top = cut_lineage(top_surts(m, limit, offset))
    hits = group_hits(m, top)
    surts = [r["surt"] for r in top.select("surt").collect()]          # at most ``limit``
    tl = timeline_hits(surt_timeline(top, success, query.start, query.end, surts),
                       hit_captures(hits, success, expand_duplicates, surts))
    return SearchResult(m, facets, facet_years(m, ly), search_total(facets, limit), top, hits, tl,
                        page_results(top, hits, tl), page_hits(hits, docs, query, snippet_chars))
