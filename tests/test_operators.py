"""Operator behaviour on small inline fixtures: quirk decisions (D-numbers of the survey), plan shape checks."""

import datetime as dt
import os
import uuid

from pyspark.sql import functions as F

from tidemark.operators import dedup, extract, patterns, quality, search, snippet
from tidemark.session import checkpoint_dir
from tidemark.sources import cdx, redirects


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_wins_upsert(spark):
    # the reference test: two inserts of the same (surt, ts) keep the first row; a different ts is a new row
    rows = [("com,x)/", dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1), 0, 1, 200),
            ("com,x)/", dt.datetime(2020, 1, 2), dt.datetime(2021, 1, 2), 0, 2, 200),
            ("com,x)/", dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 3), 0, 3, 404)]
    df = spark.createDataFrame(rows, "surt string, captured_at timestamp, crawl_ts timestamp, page int, "
                                     "capture_id long, status_code int")
    out = {(r.captured_at.day, r.capture_id, r.status_code) for r in dedup.capture_dedup(df).collect()}
    assert out == {(1, 1, 200), (2, 2, 200)}


def test_first_by_is_partial_aggregate(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    out = dedup.first_by(df, ["k"], [F.negative("v")], ["v"])
    assert sorted((r.k, r.v) for r in out.collect()) == [(0, 999), (1, 997), (2, 998)]
    plan = _plan(out)
    assert "Window" not in plan


def test_top_surts_real_offset_and_order(spark):
    # Offset skips groups, highest score first, ties by SURT, one entry per SURT
    m = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 4.0), ("c", 4.0), ("d", 0.5)], "surt string, score double")
    first = [(r.rank, r.surt) for r in search.top_surts(m, 2, 0).orderBy("rank").collect()]
    second = [(r.rank, r.surt) for r in search.top_surts(m, 2, 2).orderBy("rank").collect()]
    assert first == [(1, "a"), (2, "b")]
    assert second == [(3, "c"), (4, "d")]


def test_cdx_header_skipped_and_row_rejects(spark):
    # The header literal is not a digest; D15: one bad row does not abort the page
    path = checkpoint_dir(spark, f"t-cdx-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "p.json"), "w") as f:
        f.write('[["urlkey","timestamp","original","mimetype","statuscode","digest","length"],'
                '["com,x)/","20200101000000","http://x.com/","text/html","200","AAAA","10"],'
                '["com,x)/a","20200101000001","http://x.com/a","text/html","abc","BBBB","11"],'
                '["com,x)/b","2020","http://x.com/b","text/html","-","CCCC","12"]]')
    rows = cdx.decode_rows(cdx.read_pages(spark, path)).orderBy("pos").collect()
    assert [r.digest for r in rows] == ["AAAA", "BBBB", "CCCC"]
    assert [r._error for r in rows] == [None, "status", "timestamp"]
    assert "digest" not in [r.digest for r in cdx.page_digests(cdx.read_pages(spark, path)).collect()]


def test_cdx_strict_rows(spark):
    # a key that is none, 32 symbols that are no digest, an offset that is no number; a short digest is kept as it is
    path = checkpoint_dir(spark, f"t-cdx3-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    head = ",".join(f'"{h}"' for h in cdx.FULL_HEADER)
    row = '["{k}","20200101000000","http://x.com/","text/html","200","{d}","-","-","10","{o}","f"]'
    bad = [("COM,X)/", "A" * 32, "1"), ("com,x", "A" * 32, "1"), ("com,x)/", "1" * 32, "1"), ("com,x)/", "A" * 32, "x"),
           ("com,x)/", "A" * 32, "1"), ("com,x)/", "short", "1")]
    with open(os.path.join(path, "1577836800000.json"), "w") as f:
        f.write(f"[[{head}]," + ",".join(row.format(k=k, d=d, o=o) for k, d, o in bad) + "]")
    rows = cdx.decode_rows(cdx.read_pages(spark, path)).orderBy("pos").collect()
    assert [r._error for r in rows] == ["key", "key", "digest", "offset", None, None]
    assert rows[0].page_ts == dt.datetime(2020, 1, 1)


def test_cdx_other_column_order(spark):
    path = checkpoint_dir(spark, f"t-cdx2-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "p.json"), "w") as f:
        f.write('[["original","timestamp","digest","mimetype","length","statuscode"],'
                '["http://x.com/","20200101000000","AAAA","text/html","10","302"]]')
    r = cdx.decode_rows(cdx.read_pages(spark, path)).collect()[0]
    assert (r.layout, r.original, r.status_code, r.length, r._error) == ("other", "http://x.com/", 302, 10, None)


def test_sortedness_equal_counts_as_unsorted(spark):
    lines = spark.createDataFrame([("f", 1, "a"), ("f", 2, "b"), ("f", 3, "b"), ("f", 4, "a"), ("g", 1, "z")],
                                  "file string, line_no long, line string")
    got = {(r.file, r.line_no): r.in_order for r in quality.sortedness(lines).collect()}
    assert got == {("f", 1): True, ("f", 2): True, ("f", 3): False, ("f", 4): False, ("g", 1): True}
    assert "Window" not in _plan(quality.sortedness(lines))


def test_number_lines_contiguous(spark):
    path = checkpoint_dir(spark, f"t-lines-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    for name, n in (("redirects-A.csv", 5), ("redirects-B.csv", 3)):
        with open(os.path.join(path, name), "w") as f:
            f.write("".join(f"D{i},http://x/{i}\n" for i in range(n)))
    got = redirects.read_redirects(spark, path).collect()
    by_file = {}
    for r in got:
        by_file.setdefault(r.file.rsplit("/", 1)[-1], []).append((r.line_no, r.digest))
    assert sorted(by_file["redirects-A.csv"]) == [(i + 1, f"D{i}") for i in range(5)]
    assert sorted(by_file["redirects-B.csv"]) == [(i + 1, f"D{i}") for i in range(3)]


def test_assign_patterns_modes(spark):
    caps = spark.createDataFrame([(1, "com,example,a)/u/1"), (2, "com,example,b)/x"), (3, "org,other)/")],
                                 "capture_id long, surt string").withColumn("captured_at", F.current_timestamp())
    pats = spark.createDataFrame([("com,example,a)/u/", True, "a", 1), ("com,example,b)/x", False, "bx", 2),
                                  ("com,example", True, "dom", 3), ("org,other)/zzz", True, "none", 4)],
                                 "surt string, prefix boolean, slug string, sort_id int")
    got = sorted((r.slug, r.capture_id) for r in patterns.assign_patterns(caps, pats).collect())
    assert got == [("a", 1), ("bx", 2), ("dom", 1), ("dom", 2)]


def test_snippet_ranges():
    assert snippet.merge_ranges([(0, 3), (2, 5), (5, 7)]) == [(0, 5), (5, 7)]
    frag, ranges = snippet.best_fragment("alpha beta gamma beta delta", {"beta"}, 12)
    assert frag == "alpha beta" and ranges == [(6, 10)]
    assert snippet.to_html("a<b & c", [(0, 1)]) == "<b>a</b>&lt;b &amp; c"


def test_parse_document():
    html = ('<html><head><title> Short </title><title>Longer title</title><script>var x="</p>";</script></head>'
            '<body><p>One &amp; two</p><!-- c --><a href=" http://a.com/x ">link</a><a href="/rel">r</a>'
            '<img src="https://www.gravatar.com/avatar/abc123?s=80"><script>inline()</script></body></html>')
    d = extract.parse_document(html)
    assert d["title"] == "Longer title"
    assert d["content"] == ["One & two", "link", "r", "inline()"]
    assert d["links"] == ["http://a.com/x"]
    assert d["gravatar_hashes"] == ["abc123"]
    assert extract.parse_document(html, "https://site.org")["links"] == ["http://a.com/x", "https://site.org/rel"]


def test_native_extraction_matches_python(spark, sf_small):
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    py = extract.extract_documents(pages, "html").select("page_id", F.col("doc.title").alias("t"))
    nat = extract.extract_native(pages, "html").select("page_id", F.col("doc.title").alias("n"))
    j = py.join(nat, "page_id")
    assert j.count() == pages.count()
    assert j.where("t <> n").count() == 0


def test_search_must_and_phrase(spark):
    docs = spark.createDataFrame(
        [("d1", "com,a)/", dt.datetime(2020, 1, 1), "s", 2020, "Cats", "the cat sat on the mat", []),
         ("d2", "com,b)/", dt.datetime(2021, 1, 1), "s", 2021, "Dogs", "the dog sat", []),
         ("d3", "com,c)/", dt.datetime(2022, 1, 1), "s", 2022, "Mat", "mat the cat", [])],
        "snapshot string, surt string, captured_at timestamp, slug string, year int, title string, content string, "
        "hashes array<string>")
    post = search.postings(docs)
    got = lambda q: sorted(r.snapshot for r in search.search_matches(docs, post, q).collect())
    assert got(search.Query(should="cat dog")) == ["d1", "d2", "d3"]
    assert got(search.Query(must="cat", must_not="mat")) == []
    assert got(search.Query(must="sat", must_not="dog")) == ["d1"]
    assert got(search.Query(phrase="the cat")) == ["d1", "d3"]
    assert got(search.Query(phrase="cat the")) == []
    assert got(search.Query(should="mat", fields=("title",))) == ["d3"]
    assert got(search.Query(should="cat", years=(2022,))) == ["d3"]
    # a phrase is one more OR clause; several phrases; nested groups; a clause without words is left out
    both = search.Query(should="dog", phrase="the cat")
    assert got(both) == sorted(set(got(search.Query(should="dog"))) | {"d1", "d3"})
    assert got(search.Query(phrase=("the cat", "cat the"))) == ["d1", "d3"]
    G, W, P = search.Group, search.Words, search.Phrase
    assert got(search.Query(group=G(must=(P("the cat"), W("mat", ("title",)))))) == ["d3"]
    assert got(search.Query(group=G(should=(W("dog"), G(must=(W("cat"),), must_not=(W("sat"),)))))) == sorted(
        set(got(search.Query(should="dog"))) | set(got(search.Query(must="cat", must_not="sat"))))
    assert got(search.Query(should="...", group=G(must_not=(W("cat"),)))) == []
    assert got(search.Query(should="", phrase="")) == []
    # a required term ranks, an optional one only adds
    s = {r.snapshot: r.score for r in search.search_matches(docs, post, search.Query(must="cat", should="mat")).collect()}
    t = {r.snapshot: r.score for r in search.search_matches(docs, post, search.Query(must="cat")).collect()}
    assert set(s) == set(t) and all(s[k] >= t[k] for k in t) and s["d3"] > t["d3"]


def test_search_api_and_gravatar_filter(spark):
    docs = spark.createDataFrame(
        [("d1", "com,a)/", dt.datetime(2020, 1, 1), "s1", 2020, "Cats", "the cat sat", ["abc"]),
         ("d2", "com,a)/", dt.datetime(2021, 1, 1), "s1", 2021, "Cats", "cat cat", []),
         ("d3", "com,c)/", dt.datetime(2022, 1, 1), "s2", 2022, "Mat", "a cat", [])],
        "snapshot string, surt string, captured_at timestamp, slug string, year int, title string, content string, "
        "hashes array<string>")
    succ = docs.select("snapshot", "surt", "captured_at")
    pats = spark.createDataFrame([("s1", 1), ("s2", 2), ("s3", 3)], "slug string, sort_id int")
    post = search.postings(docs)
    r = search.search(docs, post, succ, pats, search.Query(should="cat"), limit=1)
    assert [(x.surt, x.n_hits) for x in r.top.collect()] == [("com,a)/", 2)]
    assert {x.slug: x.n for x in r.collection_facets.collect()} == {"s1": 2, "s2": 1, "s3": 0}
    assert r.total.collect()[0].total == 3
    assert r.pages.collect()[0].n_captures == 2
    g = search.search_matches(docs, post, search.Query(should="cat", gravatar_hash="abc"))
    assert [x.snapshot for x in g.collect()] == ["d1"]


def test_cdx_pretty_printed_page(spark):
    path = checkpoint_dir(spark, f"t-cdx3-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "p.json"), "w") as f:
        f.write('[\n ["urlkey","timestamp","original","mimetype","statuscode","digest","length"],\n'
                ' ["com,x)/","20200101000000","http://x.com/","text/html","200","AAAA","10"]\n]\n')
    rows = cdx.decode_rows(cdx.read_pages(spark, path)).collect()
    assert [(r.surt, r._error) for r in rows] == [("com,x)/", None)]


def test_hit_captures_expand_duplicates(spark):
    # By default only captures of the ranked SURT; expand_duplicates adds the same body seen under other SURTs
    hits = spark.createDataFrame([("d1", "com,a)/", 2.0, 1)], "snapshot string, surt string, score double, rank int")
    succ = spark.createDataFrame([("d1", "com,a)/", dt.datetime(2020, 1, 1)), ("d1", "com,b)/", dt.datetime(2020, 1, 2))],
                                 "snapshot string, surt string, captured_at timestamp")
    assert [r.surt for r in search.hit_captures(hits, succ).collect()] == ["com,a)/"]
    assert sorted(r.surt for r in search.hit_captures(hits, succ, True).collect()) == ["com,a)/", "com,b)/"]


def test_pages_of_equal_crawl_time_are_all_kept(spark, tmp_path):
    import datetime as dt
    from tidemark.sources import cdx
    from tidemark.streaming.ingest import _exists, _table_or_empty
    t = dt.datetime(2020, 1, 1)
    rows = [(i, t, f"com,example)/{i}", t, f"https://example.com/{i}", "text/html", 200, "A" * 32, 10) for i in range(6)]
    caps = spark.createDataFrame(rows, "capture_id long, crawl_ts timestamp, surt string, captured_at timestamp, "
                                       "url string, mime_type string, status_code int, digest string, length long")
    cdx.write_pages(caps.coalesce(1), f"{tmp_path}/pages", rows_per_page=2)
    got = cdx.decode_rows(cdx.read_pages(spark, f"{tmp_path}/pages"))
    assert got.count() == 6 and got.where("_error is not null or page_ts is null").count() == 0
    # stores of other writers name the file by its time
    (tmp_path / "store").mkdir()
    (tmp_path / "store" / "1577836800000.json").write_text('[["urlkey"]]')
    assert cdx.read_pages(spark, f"{tmp_path}/store").where("unix_millis(page_ts) = 1577836800000").count() == 1
    # a broken table raises instead of passing as empty
    assert not _exists(spark, f"{tmp_path}/none") and _table_or_empty(spark, f"{tmp_path}/none", caps).count() == 0
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("no parquet")
    try:
        _table_or_empty(spark, f"{tmp_path}/broken", caps).count()
    except Exception:  # noqa: BLE001
        pass
    else:
        raise AssertionError("a table that can't be read must raise")


def test_patterns_of_one_host(spark):
    from tidemark.operators.patterns import assign_patterns
    surts = [f"com,example)/u{i}/p{j}" for i in range(200) for j in range(3)] + ["com,example)/u1", "org,x)/"]
    caps = spark.createDataFrame([(k, s, None) for k, s in enumerate(surts)], "capture_id long, surt string, captured_at timestamp")
    pats = [(f"s{i}", i, f"com,example)/u{i}/", True) for i in range(1000)] + [("e", 1000, "com,example)/u1", False), ("d", 1001, "org,", True)]
    p = spark.createDataFrame(pats, "slug string, sort_id int, surt string, prefix boolean")
    got = assign_patterns(caps, p)
    want = sorted((s, i, k) for s, i, t, pre in pats for k, u in enumerate(surts) if (u.startswith(t) if pre else u == t))
    assert sorted((r["slug"], r["sort_id"], r["capture_id"]) for r in got.collect()) == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_fragment_keeps_its_limit_and_corrupt_bodies_are_null(spark):
    from pyspark.sql import functions as F
    from tidemark.operators.snippet import best_fragment
    from tidemark.sources.store import zstd_compress, zstd_decompress
    assert len(best_fragment("abcdefghij klmnopqrst uvwxyz", {"zz"}, 5)[0]) <= 5
    d = spark.createDataFrame([(bytearray(b"body"),)], "b binary").withColumn("z", zstd_compress("b"))
    d = d.select(zstd_decompress("z").alias("ok"), zstd_decompress(F.unhex(F.lit("28B52FFD00FF"))).alias("bad"))
    assert bytes(d.first()["ok"]) == b"body" and d.first()["bad"] is None


def test_pages_without_body_or_head_keep_their_text():
    from tidemark.operators.extract import absolute_link, parse_document
    assert parse_document("<title>t</title><p>Hello</p>")["content"] == ["Hello"]
    assert parse_document("Hello <b>there</b>")["content"] == ["Hello", "there"]
    d = parse_document("<html><head><title>t</title><style>p{}</style></head>\n<body><p>x</p></body></html>")
    assert d["title"] == "t" and d["content"] == ["x"]
    o = "https://site.example"
    assert [absolute_link(o, h) for h in ("/a", "b", "//c/d", "http://e", "#f", "mailto:g@h", "javascript:x", "")] == [
        o + "/a", o + "/b", "https://c/d", "http://e", None, None, None, None]


def test_a_worker_holds_few_pages_and_few_texts_at_a_time():
    import pandas as pd
    import pyarrow as pa
    from tidemark.operators import extract as ex, search as srch
    pages = pd.Series([None if i % 7 == 0 else f"<title>t{i}</title><body><a href='/{i}'>x</a>" for i in range(200)])
    parts = list(ex._parse_batches(iter([pages, pages[:1], pages[:0]])))
    assert max(map(len, parts)) <= ex.PAGES_AT_ONCE
    assert [r for p in parts for r in p["title"]] == [r["title"] for r in map(ex._parse, [*pages, pages[0]])]

    toks = [None if i % 9 == 0 else [f"w{i % 5}", None, "all", f"w{i % 5}"] for i in range(1000)]
    whole = pa.RecordBatch.from_arrays([pa.array([f"s{i}" for i in range(1000)]), pa.array(["content"] * 1000),
                                        pa.array(toks, pa.list_(pa.string()))], names=["snapshot", "field", "toks"])
    out = list(srch._group_tokens([whole, whole.slice(0, 0)]))
    assert max(len(set(b.column("snapshot").to_pylist())) for b in out) <= srch.TEXTS_AT_ONCE < 1000
    got = sorted((r["snapshot"], r["token"], r["tf"], r["dl"], tuple(r["positions"])) for b in out for r in b.to_pylist())
    assert got == sorted(x for i, t in enumerate(toks) if t for x in ((f"s{i}", f"w{i % 5}", 2, 3, (0, 3)), (f"s{i}", "all", 1, 3, (2,))))
