"""T6 / B23 snippets: best fragment of a hit's content (at most N characters, cut at token boundaries) with the
query terms highlighted; HTML-escaped, overlapping highlight ranges merged (touching ones kept apart).

Runs on the ranked hits only (at most limit x hits-per-page rows), never on the whole collection, and in built-in
expressions. ``best_fragment`` and ``to_html`` are the same for a single text at hand.
"""

from __future__ import annotations

import html as _html

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import MAX_TOKEN_BYTES, TOKEN_PATTERN, html_escape, keep_token, raw_tokens

_TOKEN_RE = regex.compile(TOKEN_PATTERN)


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Merge overlapping [start, end) ranges; ranges that only touch stay separate."""
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def to_html(fragment: str, ranges: list[tuple[int, int]], tag: str = "b") -> str:
    """Escape & < > and wrap highlighted ranges (character offsets into ``fragment``)."""
    parts, pos = [], 0
    for s, e in merge_ranges(ranges):
        parts.append(_html.escape(fragment[pos:s], quote=False))
        parts.append(f"<{tag}>{_html.escape(fragment[s:e], quote=False)}</{tag}>")
        pos = e
    parts.append(_html.escape(fragment[pos:], quote=False))
    return "".join(parts)


def best_fragment(text: str, terms: set[str], max_chars: int) -> tuple[str, list[tuple[int, int]]]:
    """Highest-scoring window of whole tokens no longer than ``max_chars`` (score = matched term occurrences;
    earliest window wins a tie). Returns the fragment and its highlight ranges."""
    toks = [(m.start(), m.end(), m.group().lower()) for m in _TOKEN_RE.finditer(text or "")
            if len(m.group().encode()) < MAX_TOKEN_BYTES]
    if not toks:
        return (text or "")[:max_chars], []
    best, best_score, j, score = (0, 0), -1, 0, 0
    for i in range(len(toks)):
        if i > 0 and j >= i and toks[i - 1][2] in terms:   # the window before held it
            score -= 1
        j = max(j, i)
        while j < len(toks) and toks[j][1] - toks[i][0] <= max_chars:
            score += toks[j][2] in terms
            j += 1
        if j == i:  # a single token longer than the window
            continue
        if score > best_score:
            best, best_score = (i, j), score
    if best_score < 0:  # every token is longer than the window
        return text[toks[0][0]:toks[0][0] + max_chars], []
    i, j = best
    start, end = toks[i][0], toks[j - 1][1]
    frag = text[start:end]
    ranges = [(s - start, e - start) for s, e, t in toks[i:j] if t in terms]
    return frag, ranges


def _tokens(hits: DataFrame, keys: list[str], words: list[str]) -> DataFrame:
    """(keys, s, e, hit) of the tokens of ``content``: character offsets, and whether a query word stands there.

    Offsets are running sums over the tokens and the gaps between them, per text, so a long text costs no more than its
    tokens."""
    text = F.coalesce("content", F.lit(""))
    cut = hits.select(*keys, F.explode(F.array(F.struct(raw_tokens(text).alias("toks"), F.split(text, TOKEN_PATTERN, -1).alias("gaps")))).alias("c"))
    rows = (cut.select(*keys, F.posexplode(F.arrays_zip("c.toks", "c.gaps")).alias("i", "z"))
            .select(*keys, "i", F.col("z.toks").alias("t"), F.char_length("z.gaps").alias("gap")).where("t IS NOT NULL"))
    before = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    n = F.char_length("t")
    end = F.sum(F.col("gap") + n).over(before)
    word = F.lower("t").isin(words) if words else F.lit(False)
    return (rows.select(*keys, (end - n).alias("s"), end.alias("e"), word.alias("hit"), keep_token(F.col("t")).alias("kept"))
            .where("kept").drop("kept"))


def highlighted(fragment: Column, ranges: Column, tag: str = "b") -> Column:
    """The escaped fragment with its ranges (array of struct(s, e), sorted, apart) in a tag."""
    def part(a, b):
        return html_escape(F.substring(fragment, a + 1, b - a))

    def add(acc, r):
        return F.struct(F.concat(acc["html"], part(acc["at"], r["s"]), F.lit(f"<{tag}>"), part(r["s"], r["e"]),
                                 F.lit(f"</{tag}>")).alias("html"), r["e"].alias("at"))

    start = F.struct(F.lit("").alias("html"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(ranges, start, add, lambda acc: F.concat(acc["html"], part(acc["at"], F.char_length(fragment).cast("long"))))


def snippets(hits: DataFrame, query, max_chars: int = 200) -> DataFrame:
    """T6 + B23: adds ``snippet`` (HTML) to ranked hits that carry ``content`` (one row per ``snapshot``).

    Of all windows of whole tokens, at most ``max_chars`` long, the first with the most words of the query is shown; a
    content without tokens shows its beginning. All in built-in expressions over the hits' tokens: a window's words are
    a range frame over the offsets, less the one token that may stick out at its end."""
    keys = ["snapshot"]
    toks = _tokens(hits, keys, query.positive_words())
    frame = Window.partitionBy(*keys).orderBy("s").rangeBetween(0, max_chars)
    last = F.last(F.struct("e", "hit")).over(frame)
    out = F.when((last["e"] > F.col("s") + max_chars) & last["hit"], 1).otherwise(0)
    scored = (toks.withColumn("score", F.sum(F.col("hit").cast("int")).over(frame) - out)
              .where(F.col("e") <= F.col("s") + max_chars))
    best = scored.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("score"), "s"))["s"].alias("s"))
    own = toks.join(best.withColumnRenamed("s", "at"), keys).where((F.col("s") >= F.col("at")) & (F.col("e") <= F.col("at") + max_chars))
    # at most ``max_chars`` tokens per row
    window = own.groupBy(*keys, "at").agg(
        F.max("e").alias("end"),
        F.sort_array(F.collect_list(F.when(F.col("hit"), F.struct((F.col("s") - F.col("at")).alias("s"),
                                                                  (F.col("e") - F.col("at")).alias("e"))))).alias("ranges"))
    first = toks.groupBy(*keys).agg(F.min("s").alias("first"))
    text = F.coalesce("content", F.lit(""))
    fragment = F.substring(text, F.coalesce(F.col("at"), "first", F.lit(0)) + 1, F.coalesce(F.col("end") - F.col("at"), F.lit(max_chars)))
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    shown = hits.join(window, keys, "left").join(first, keys, "left")
    return shown.select(*[c for c in hits.columns if c != "content"],
                        highlighted(fragment, F.coalesce("ranges", none)).alias("snippet"))
