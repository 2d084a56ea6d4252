"""References resolved by built-in expressions: the examples of RFC 3986 section 5.4, and odd ones against the standard
library."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from tidemark import functions as tf
from tidemark.operators import extract as ex

BASE = "http://a/b/c/d;p?q"
# RFC 3986 sections 5.4.1 and 5.4.2 (the strict form of the last one)
EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g",
    "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s",
    "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s",
    "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/",
    "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g",
    "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.",
    ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g",
    "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y",
    "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x",
    "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def _resolve(spark, rows):
    df = spark.createDataFrame(rows, "base string, ref string")
    return [r["u"] for r in df.select(tf.resolve_reference("base", "ref").alias("u")).collect()]


def test_examples_of_the_standard(spark):
    assert _resolve(spark, [(BASE, r) for r in EXAMPLES]) == list(EXAMPLES.values())
    assert [ex.resolve(BASE, r) for r in EXAMPLES] == list(EXAMPLES.values())


def test_odd_references(spark):
    bases = ["http://h", "https://h/", "http://h?x", "http://h/a", "http://h/a/../b/c", "http://h:80/p/q?r#s"]
    refs = ["a", "../a", "/a/./b/..", "?n", "//x", "a//b/../c", "./", "x/" * 40 + "../" * 39 + "y", "über/../straße"]
    rows = [(b, r) for b in bases for r in refs]
    got = _resolve(spark, rows)
    assert got == [ex.resolve(b, r) for b, r in rows]
    assert dict(zip(rows, got))[("http://h/a", "a//b/../c")] == "http://h/a//c"       # an empty segment is one
    plain = [(b, r) for b, r in rows if "//" not in r and "/" in b[8:]]
    assert [ex.resolve(b, r) for b, r in plain] == [urljoin(b, r) for b, r in plain]
    assert _resolve(spark, [("http://h/a", "//x/y/../z?/..")]) == ["http://x/z?/.."] == [ex.absolute_link("http://h/a", "//x/y/../z?/..")]
    assert _resolve(spark, [(None, "http://a/b/../c"), (None, "a"), ("", "a"), ("nonsense", "x"), (BASE, None)]) == [
        "http://a/c", None, None, None, None]


def test_links_of_a_page(spark):
    html = ('<html><head><base href="/sub/x"><base href="http://no.example/"></head><body><a href=" y ">1</a><a href="#f">2</a>'
            '<a href="">3</a><a href="mailto:a@b">4</a><a href="http:z">5</a><a name="n">6</a><a href="../q">7</a></body></html>')
    rows = [(1, "https://s.example/d/e", html), (2, None, html), (3, "https://s.example/d/e", html.replace("base", "b"))]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r["page_id"]: list(r["links"]) for r in ex.extract_documents(df, "html", F.col("url")).select("page_id", "doc.links").collect()}
    want = ["https://s.example/sub/y", "http:z", "https://s.example/q"]
    assert got == {1: want, 2: ["http:z"], 3: ["https://s.example/d/y", "http:z", "https://s.example/q"]}
    assert ex.parse_document(html, "https://s.example/d/e")["links"] == want
    assert [r["links"] for r in ex.extract_documents(df.where("page_id = 1"), "html").select("doc.links").collect()] == [["http:z"]]


def test_character_references(spark):
    import html
    texts = ["a &amp; b", "&quot;&copy;&middot;&lt;&gt;&eacute;&NotEqualTilde;&lang;", "&#65;&#x41;&#X1F600;&#8364;", "&#128;&#150;&#0;",
             "&copy 2020 &amp", "&nosuch; &;&# &#x; & x", "&#xD800;&#1114112;&#99999999999999999999;", "&amp;amp;", "", None, "&#00065;",
             "caf&eacute;, na&iuml;ve &ndash; &hellip;"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["u"] for r in df.select("i", tf.html_unescape("t").alias("u")).collect()}
    assert got == {i: None if t is None else html.unescape(t) for i, t in enumerate(texts)}
