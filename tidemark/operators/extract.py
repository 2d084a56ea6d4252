"""T1 document extraction from HTML bodies, link dumps (S18) and the page -> link graph (I8).

Two paths:
  * ``extract_documents``: Arrow-batched pandas UDF around the standard-library HTML tokenizer (per row a small
    helper; Spark partitions and schedules the work). Gives title, body text nodes, links and avatar hashes.
  * ``extract_native``: title / links / avatar hashes with built-in regex expressions only (stays in whole-stage
    codegen) for well-formed pages when body text is not needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import html_unescape, page_link, surt_from_url
from tidemark.functions.urls import REFERENCE_PATTERN

#: What the tokenizer gives of a page; links are resolved from it in built-in expressions.
PARSED_TYPE = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("content", T.ArrayType(T.StringType())),
    T.StructField("hrefs", T.ArrayType(T.StringType())),
    T.StructField("base_href", T.StringType()),
    T.StructField("gravatar_hashes", T.ArrayType(T.StringType())),
])

# Avatar image source pattern; only links starting with 'http' are kept.
GRAVATAR_SRC_RE = re.compile(r"gravatar\.com/avatar/([0-9a-f]+)")
GRAVATAR_SRC_PATTERN = r"gravatar\.com/avatar/([0-9a-f]+)"
ORIGIN_PATTERN = r"^(https?://[^/?#]+)"
_HTTP = re.compile("https?://", re.IGNORECASE)
_REFERENCE = re.compile(REFERENCE_PATTERN)
_TEXT_HOLDERS = {"title", "style", "script", "noscript", "template"}
_HEAD_ONLY = {"title", "meta", "link", "style", "script", "base", "noscript", "template"}


class _DocumentParser(HTMLParser):
    """Collects title candidates (text of <title> inside <head>), trimmed non-empty text nodes under <body> in
    document order (script/style text included), <a href> values and avatar <img src> values."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.in_body = False
        self.held = 0  # open elements whose text belongs to the head
        self.in_title = 0
        self.titles: list[str] = []
        self.content: list[str] = []
        self.hrefs: list[str] = []
        self.base_href: str | None = None
        self.avatar_srcs: list[str] = []
        self._buf: list[str] = []

    def _flush(self):
        if self._buf:
            text = "".join(self._buf).strip()
            self._buf = []
            if not text:
                return
            if self.in_title and not self.in_body:
                self.titles.append(text)
            elif self.in_body:
                self.content.append(text)

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag not in _HEAD_ONLY and tag not in ("html", "head"):  # <body> itself may be left out
            self.in_body = True
        if tag in _TEXT_HOLDERS:
            self.held += 1
        if tag == "title":
            self.in_title += 1
        a = dict(attrs)
        if tag == "a" and a.get("href") is not None:
            self.hrefs.append(a["href"].strip())
        if tag == "base" and a.get("href") is not None and self.base_href is None:   # the first one counts
            self.base_href = a["href"].strip()
        if tag == "img" and "gravatar.com" in (a.get("src") or ""):
            self.avatar_srcs.append(a["src"])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        if tag == "title":
            self.in_title = max(0, self.in_title - 1)
        if tag in _TEXT_HOLDERS:
            self.held = max(0, self.held - 1)

    def handle_data(self, data):
        if not self.held and not self.in_body and data.strip():
            self.in_body = True
        self._buf.append(data)

    def handle_comment(self, data):
        self._flush()

    def close(self):
        super().close()
        self._flush()


def absolute_link(base: str | None, href: str) -> str | None:
    """``href`` as an http(s) link of a page at ``base``; None for fragments, other schemes, and relative links without
    a base. The form of ``functions.page_link`` for a single link."""
    if href.startswith("http"):
        return href
    if base is None or not href or href.startswith("#"):
        return None
    url = resolve(base, href)
    return url if url and _HTTP.match(url) else None


def _without_dots(path: str) -> str:
    kept: list[str] = []
    segments = path.split("/")
    for s in segments:
        if s == "..":
            if len(kept) > 1 or kept and kept[0]:
                kept.pop()
        elif s != ".":
            kept.append(s)
    return "/".join(kept + [""] if segments[-1] in (".", "..") else kept)


def resolve(base: str, ref: str) -> str | None:
    """RFC 3986 section 5.2, the form of ``functions.resolve_reference`` for a single reference."""
    b, r = ([g or "" for g in _REFERENCE.match(x).groups()] for x in (base, ref))
    if r[0] or r[1]:
        scheme, host, path, query = r[0] or b[0], r[1], _without_dots(r[2]), r[3]
    elif not r[2]:
        scheme, host, path, query = b[0], b[1], b[2], r[3] or b[3]
    else:
        folder = "/" if b[1] and not b[2] else b[2][:b[2].rfind("/") + 1]
        scheme, host, path, query = b[0], b[1], _without_dots(r[2] if r[2].startswith("/") else folder + r[2]), r[3]
    return f"{scheme}:{host}{path}{query}{r[4]}" if scheme else None


def _parse(html: str | None) -> dict:
    """Title (longest in bytes of the non-empty title texts, the last one on a tie), text nodes, hrefs, avatar hashes."""
    p = _DocumentParser()
    if html:
        p.feed(html)
        p.close()
    title = ""
    for t in p.titles:
        if len(t.encode()) >= len(title.encode()):
            title = t
    hashes = sorted({m for src in p.avatar_srcs for m in GRAVATAR_SRC_RE.findall(src)})
    return {"title": title, "content": p.content, "hrefs": p.hrefs, "base_href": p.base_href, "gravatar_hashes": hashes}


def parse_document(html: str | None, base: str | None = None) -> dict:
    """Extract one page. With ``base`` (the page's URL) relative hrefs are resolved, against the page's <base> where it
    has one; fragments and other schemes are dropped."""
    d = _parse(html)
    hrefs, own = d.pop("hrefs"), d.pop("base_href")
    if base is not None and own:
        base = absolute_link(base, own) or base
    return d | {"links": [h for h in (absolute_link(base, h) for h in hrefs) if h]}


#: Pages whose parts a worker holds at a time, whatever the number of rows in an Arrow batch.
PAGES_AT_ONCE = 64


def _parse_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for html in batches:
        for at in range(0, len(html), PAGES_AT_ONCE):
            yield pd.DataFrame([_parse(h) for h in html.iloc[at:at + PAGES_AT_ONCE]], columns=[f.name for f in PARSED_TYPE])


_extract_udf = F.pandas_udf(_parse_batches, PARSED_TYPE)


def page_origin(url) -> Column:
    u = F.col(url) if isinstance(url, str) else url
    return F.nullif(F.regexp_extract(u, ORIGIN_PATTERN, 1), F.lit(""))


def extract_documents(df: DataFrame, html_col: str = "html", base: Column | None = None) -> DataFrame:
    """Adds ``doc`` struct(title, content, links, gravatar_hashes). ``base`` (the page's URL) makes relative links
    absolute, honouring <base href>; without it only absolute links are kept."""
    url = base if base is not None else F.lit(None).cast("string")
    parsed = df.withColumn("_parsed", _extract_udf(F.col(html_col))).withColumn("_url", url)
    own = F.nullif(F.col("_parsed.base_href"), F.lit(""))
    parsed = parsed.withColumn("_base", F.coalesce(page_link("_url", own), "_url"))
    links = F.filter(F.transform("_parsed.hrefs", lambda h: page_link("_base", h)), lambda x: x.isNotNull())
    doc = F.struct("_parsed.title", "_parsed.content", links.alias("links"), "_parsed.gravatar_hashes")
    return parsed.withColumn("doc", doc).drop("_parsed", "_url", "_base")


def extract_native(df: DataFrame, html_col: str = "html") -> DataFrame:
    """Title (longest, last on tie: first <title> of <head> for well-formed pages), absolute links and sorted
    distinct avatar hashes with built-in expressions only."""
    h = F.col(html_col)
    head = F.substring_index(h, "</head>", 1)
    title = F.trim(F.regexp_extract(head, r"(?s)<title[^>]*>([^<]*)</title>", 1))
    hrefs = F.transform(F.regexp_extract_all(h, F.lit(r"""<a\s[^>]*?href="([^"]*)\""""), 1), lambda x: F.trim(html_unescape(x)))
    srcs = F.regexp_extract_all(h, F.lit(r"""<img\s[^>]*?src="([^"]*gravatar\.com[^"]*)\""""), 1)
    hashes = F.array_sort(F.array_distinct(F.flatten(
        F.transform(srcs, lambda s: F.regexp_extract_all(s, F.lit(GRAVATAR_SRC_PATTERN), 1)))))
    return df.withColumn("doc", F.struct(
        html_unescape(title).alias("title"),
        F.filter(hrefs, lambda x: x.startswith("http")).alias("links"),
        hashes.alias("gravatar_hashes")))


def link_rows(docs: DataFrame, key_cols=("page_id",)) -> DataFrame:
    """One row per extracted link, in page order, not de-duplicated."""
    return docs.select(*key_cols, F.posexplode("doc.links").alias("pos", "link"))


def link_graph(docs: DataFrame, key_cols=("page_id",)) -> DataFrame:
    """I8: distinct (page, link url, link SURT) edges; links without a SURT (not http/https, IP host) dropped."""
    rows = docs.select(*key_cols, F.explode("doc.links").alias("link"))
    return rows.select(*key_cols, "link", surt_from_url("link").alias("link_surt")).where("link_surt IS NOT NULL").distinct()
