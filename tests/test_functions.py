"""Golden values for the scalar functions (the reference's own unit-test facts) plus edge cases."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark import functions as tf


def one(spark, col):
    return spark.range(1).select(col.alias("v")).collect()[0]["v"]


def test_surt_from_url_golden(spark):
    assert one(spark, tf.surt_from_url(F.lit("https://social.example/SomeBody/"))) == "example,social)/somebody/"


def test_surt_from_url_edges(spark):
    cases = {
        "http://www.Example.com": "com,example,www)/",
        "http://example.com/a/b?q=1#f": "com,example)/a/b",
        "https://user:pw@example.com:443/x": "com,example)/x",
        "http://example.com:80/x": "com,example)/x",
        "http://example.com:8080/x": None,
        "ftp://example.com/x": None,
        "http://127.0.0.1/x": None,
        "http:///x": None,
        "not a url": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string").select("u", tf.surt_from_url("u").alias("s"))
    got = {r.u: r.s for r in df.collect()}
    assert got == cases


def test_surt_roundtrip_and_canonical(spark):
    s = "com,example,social)/somebody/status/42"
    parsed = tf.surt_parse(F.lit(s))
    assert one(spark, F.size(parsed["domain"])) == 3
    assert one(spark, tf.surt_text(parsed)) == s
    assert one(spark, tf.surt_canonical_url(F.lit(s))) == "https://social.example.com/somebody/status/42"


def test_surt_parse_rejects(spark):
    for bad in ["Com,twitter)/x", "com,twi_tter)/x", "com,twitter", "com,twitter)x"]:
        assert one(spark, tf.surt_parse(F.lit(bad))) is None, bad


def test_ts14(spark):
    ts = one(spark, tf.ts14_parse(F.lit("20160508215503")))
    assert ts == dt.datetime(2016, 5, 8, 21, 55, 3)
    assert one(spark, tf.ts14_format(tf.ts14_parse(F.lit("20160508215503")))) == "20160508215503"
    assert one(spark, tf.ts14_parse(F.lit("2016050821550"))) is None
    assert one(spark, tf.ts14_parse(F.lit("20161308215503"))) is None


def test_archive_url(spark):
    u = "https://web.archive.org/web/20160508215503/https://social.example/SomeBody/status/42"
    p = tf.archive_url_parse(F.lit(u))
    assert one(spark, p["url"]) == "https://social.example/SomeBody/status/42"
    assert one(spark, tf.archive_url(p["url"], p["ts"], https=True)) == u
    assert one(spark, tf.archive_url(p["url"], p["ts"], https=False, original=True)).startswith(
        "http://web.archive.org/web/20160508215503id_/https://")
    assert one(spark, tf.archive_url_parse(F.lit("http:s://web.archive.org/web/20160508215503/x"))) is None


def test_digest(spark):
    assert one(spark, tf.content_digest(F.lit(""))) == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert one(spark, tf.content_digest(F.lit("abc"))) == "VGMT4NSHA2AWVOR6EVYXQUGCNSONBWE5"
    assert one(spark, tf.digest_kind(F.lit("ZHYT52YPEOCHJD5FZINSDYXGQZI22WJ4"))) == "valid"
    assert one(spark, tf.digest_kind(F.lit("ZHYT52YPEOCHJD5FZINSDYXGQZI22WJ1"))) == "error"
    assert one(spark, tf.digest_kind(F.lit("abc"))) == "invalid"
    assert one(spark, tf.store_location(F.lit("ZHYT52YPEOCHJD5FZINSDYXGQZI22WJ4"))) == \
        "ZH/YT/ZHYT52YPEOCHJD5FZINSDYXGQZI22WJ4.zst"
    assert one(spark, tf.store_location(F.lit("zhyt"))) is None


def test_digest_matches_python(spark):
    import base64
    import hashlib
    texts = ["", "a", "héllo wörld", "x" * 1000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tf.content_digest("t").alias("d"))
    for r in df.collect():
        assert r.d == base64.b32encode(hashlib.sha1(r.t.encode()).digest()).decode()


def test_redirect_roundtrip(spark):
    html = tf.redirect_html(F.lit("https://example.com/x"))
    assert one(spark, html) == '<html><body>You are being <a href="https://example.com/x">redirected</a>.</body></html>'
    assert one(spark, tf.redirect_target(html)) == "https://example.com/x"
    assert one(spark, tf.redirect_target(F.lit("<html>nope</html>"))) is None


def test_misc(spark):
    assert one(spark, tf.gravatar_hash(F.lit("Foo@Example.COM"))) == "b48def645758b95537d4424c84d1a9ff"
    assert one(spark, tf.status_code(F.lit("-"))) is None
    assert one(spark, tf.status_code(F.lit("302"))) == 302
    assert one(spark, tf.status_code(F.lit("70000"))) is None
    assert one(spark, tf.status_code_error(F.lit("abc"))) is True
    q = tf.pattern_from_query(F.lit("https://twitter.com/foo/*"))
    assert one(spark, q["surt"]) == "com,twitter)/foo/"
    assert one(spark, q["prefix"]) is True
    assert one(spark, tf.pattern_query(q["surt"], q["prefix"])) == "https://twitter.com/foo/*"
    assert one(spark, tf.html_escape(F.lit("a<b>&c"))) == "a&lt;b&gt;&amp;c"
    assert one(spark, tf.analyse(F.lit("Hello, Wörld 12 " + "x" * 40))) == ["hello", "wörld", "12"]


def _py_surt(url):
    """Independent reference: urllib-based SURT (same acceptance rules)."""
    import re
    from urllib.parse import urlsplit
    try:
        u = urlsplit(url.lower())
        port = u.port
    except ValueError:
        return None
    if u.scheme not in ("http", "https") or not u.hostname:
        return None
    if re.search(r"(^|[.])(0x[0-9a-f]*|[0-9]+)[.]?$", u.hostname):
        return None
    if port is not None and port != {"http": 80, "https": 443}[u.scheme]:
        return None
    return ",".join(reversed(u.hostname.split("."))) + ")" + (u.path or "/")


def test_surt_matches_python_reference(spark, sf_small):
    extra = ["https://A.B.example.org:443/x/y?z#w", "http://user@host.example.com/p", "http://h.example.com:81/",
             "http://10.0.0.1/", "https://h.example.com", "mailto:someone@example.com"]
    pages = spark.read.parquet(f"{sf_small}/pages.parquet").select("url")
    df = pages.unionByName(spark.createDataFrame([(u,) for u in extra], "url string"))
    got = {r.url: r.s for r in df.select("url", tf.surt_from_url("url").alias("s")).collect()}
    assert got == {u: _py_surt(u) for u in got}


def test_digest_and_tokens_match_python_on_documents(spark, sf_small):
    import base64
    import hashlib

    import regex

    from tidemark.operators.search import postings
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.d for r in docs.select("doc_id", tf.content_digest("text").alias("d")).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got == {k: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for k, t in texts.items()}

    d = docs.select(F.col("doc_id").cast("string").alias("snapshot"), F.lit("").alias("title"),
                    F.col("text").alias("content"))
    post = {(r.snapshot, r.pos, r.token) for r in postings(d).where("field = 'content'").collect()}
    tok = regex.compile(r"[\p{L}\p{N}]+")
    want = {(str(k), i, m.lower()) for k, t in texts.items() for i, m in enumerate(tok.findall(t))
            if len(m.encode()) < 40}
    assert post == want


def test_utc_bound_ignores_driver_time_zone(spark, monkeypatch):
    import datetime as dt
    import time
    from tidemark.functions.timefmt import utc_bound
    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    try:
        assert one(spark, F.unix_micros(utc_bound(dt.datetime(2020, 1, 1)))) == 1577836800000000
    finally:
        monkeypatch.undo()
        time.tzset()
