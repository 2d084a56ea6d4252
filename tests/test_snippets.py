"""Snippets of built-in expressions against the form for a single text; phrases over position arrays."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import search as srch
from tidemark.operators.snippet import best_fragment, snippets, to_html

rnd = random.Random(5)
WORDS = ["the", "The", "alpha", "beta", "a<b", "x&y", "über", "naïve", "日本", "o'clock", "z" * 39, "z" * 45, "—", "..", "\n"]
TEXTS = [None, "", "   ", "<>&", "the", "z" * 60, "--the--", "the the the", "alpha beta the", "<b>the</b> & more", "z" * 45 + " the " + "z" * 45,
         " ".join(["alpha"] * 50 + ["the", "beta", "the"] + ["alpha"] * 50),
         *(rnd.choice(["", " ", "<"]) + rnd.choice([" ", "-", " & "]).join(rnd.choices(WORDS, k=rnd.randrange(1, 90))) for _ in range(120))]


@pytest.mark.parametrize("chars", [1, 12, 40, 200])
def test_snippets_match_the_single_text_form(spark, chars):
    q = srch.Query(should="the beta 日本", phrase="über alpha")
    hits = spark.createDataFrame([(f"s{i}", t, i) for i, t in enumerate(TEXTS)], "snapshot string, content string, score int")
    got = {r["snapshot"]: r["snippet"] for r in snippets(hits, q, chars).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want = to_html(*best_fragment(t or "", set(q.positive_words()), chars))
        assert got[f"s{i}"] == want, (chars, t)


def test_snippets_without_words_and_without_hits(spark):
    hits = spark.createDataFrame([("a", "some <text>", 1)], "snapshot string, content string, score int")
    assert [r["snippet"] for r in snippets(hits, srch.Query(), 200).collect()] == ["some &lt;text"]
    assert snippets(hits.limit(0), srch.Query(should="x"), 200).count() == 0


def _phrase(docs, words, field):
    out = {}
    for s, text in docs:
        toks = [t.lower() if len(t.encode()) < 40 else None for t in srch._TOKEN_RE.findall(text)]
        n = sum(toks[i:i + len(words)] == words for i in range(len(toks)))
        if n:
            out[s] = n
    return out


def test_document_postings_and_phrases_match_brute_force(spark):
    vocab = ["a", "b", "a", "c", "Ab", "q" * 45, "é"]
    rows = [(f"d{i}", " ".join(rnd.choices(vocab, k=rnd.randrange(0, 40))), " ".join(rnd.choices(vocab, k=5))) for i in range(80)]
    docs = spark.createDataFrame(rows, "snapshot string, content string, title string")
    post = srch.document_postings(docs)
    want = {(r.snapshot, r.field, r.token, r.pos, r.dl) for r in srch.postings(docs).collect()}
    got = {(r.snapshot, r.field, r.token, r.pos, r.dl) for r in srch.occurrences(post).collect()}
    assert got == want and post.count() == len({w[:3] for w in want})
    assert sorted(map(tuple, srch.by_document(srch.postings(docs)).select(*post.columns).collect())) == sorted(map(tuple, post.collect()))
    stats = {"n": F.lit(80), "title": F.lit(5.0), "content": F.lit(20.0)}
    for words in (["a", "b"], ["a", "a"], ["a", "b", "a"], ["ab", "é", "c"], ["b", "nowhere"]):
        scored = srch.phrase_scores(post, stats, words, ("content",))
        assert {r["snapshot"] for r in scored.collect()} == set(_phrase([(s, c) for s, c, _ in rows], words, "content"))


def test_stored_postings_open_the_folders_of_their_tokens(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", f"w{i} common x{i % 9}", "t") for i in range(300)], "snapshot string, content string, title string")
    srch.write_postings(srch.document_postings(docs), f"{tmp_path}/p")
    post = spark.read.parquet(f"{tmp_path}/p")
    rows = srch.of_tokens(post, ["common", "w7"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 301 and "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [shard" in plan
    assert rows.select("shard").distinct().count() <= 2


def test_postings_are_written_by_the_task_that_has_the_document(spark, tmp_path):
    """No posting is shuffled: each of three tasks adds its own file, in order of tokens, to every folder."""
    import glob
    import pyarrow.parquet as pq
    post = (spark.range(0, 300, 1, 3).select(F.sha1(F.col("id").cast("string")).alias("snapshot"), F.lit("content").alias("field"),
                                             F.explode(F.sequence(F.lit(1), F.lit(200)).cast("array<string>")).alias("token"),
                                             F.lit(1).cast("long").alias("tf"), F.lit(200).cast("long").alias("dl"),
                                             F.array(F.lit(0)).alias("positions")))
    srch.write_postings(post, f"{tmp_path}/p")
    folders = glob.glob(f"{tmp_path}/p/shard=*")
    assert len(folders) == srch.SHARDS
    for folder in folders:
        files = [pq.ParquetFile(f) for f in glob.glob(f"{folder}/*.parquet")]
        assert len(files) == 3
        for f in files:
            rows = f.read(["token", "snapshot"]).to_pylist()
            assert len({r["snapshot"] for r in rows}) == 100 and rows == sorted(rows, key=lambda r: (r["token"], r["snapshot"]))
    back = spark.read.parquet(f"{tmp_path}/p").drop("shard")
    assert back.count() == 300 * 200 and back.exceptAll(post).count() == 0


def test_postings_of_whole_texts_have_the_analysers_tokens(spark):
    """One string per text is lower-cased and split, not an array per token; the tokens, places and lengths are those of
    the token expressions, whatever the letters."""
    odd = ["", None, "  ", "...", "one", " Two  three! ", "\u0391\u03a3'\u0391 \u039f\u0394\u039f\u03a3 \u03a3 A\u03a3.B", "\u0130stanbul I\u0307",
           "x" * 39 + " " + "x" * 40, "\u00e9" * 19 + " " + "\u00e9" * 20, "\u0130" * 19 + "A a", "\U00010400\U00010428 \u0661\u00bd n\u00e3o-e\u0301",
           "a\tb\nc\u00a0d\u2003e\x00f", "\u01c5 \u1e9e STRASSE"]
    docs = spark.createDataFrame([(f"d{i}", t, odd[-i - 1]) for i, t in enumerate(odd)], "snapshot string, content string, title string")
    post = srch.document_postings(docs)
    rows = lambda df: sorted((r.snapshot, r.field, r.pos, r.token, r.dl) for r in df.collect())
    assert rows(srch.occurrences(post)) == rows(srch.postings(docs))
    lengths = {(r.snapshot, f): r[f"{f}_dl"] for r in srch.with_field_lengths(docs).collect() for f in srch.FIELDS}
    held = {(r.snapshot, r.field): r.dl for r in post.collect()}
    assert lengths == {k: held.get(k, 0) for k in lengths} and len(lengths) == 2 * len(odd)
    plan = post._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "lambdafunction" not in plan


def test_bodies_are_hashed_once_for_all_tables_of_the_archive(spark, sf_small):
    from tidemark.plans import fixtures as fx
    plan = fx.success.build(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "sha1" not in plan.lower()
