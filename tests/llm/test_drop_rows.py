"""Filtering operators on odd rows: nulls, repeats, ties, clashing columns, empty tables."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import exact_dedup, simhash

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(60))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, LONG, "en", "a", 1), (None, LONG + " ", "en", "b", 2), (None, LONG, "de", "c", 3), (7, "x y", "en", "a", 1),
            (7, "x y", "en", "a", 1), (7, "x  y", "en", "z", 9), (3, "x y", "en", "a", 1), (5, None, "en", "a", 1), (6, "", None, None, None),
            (9, " \n", "en", "a", 1), (8, "other words stand in this one", "en", "a", 1), (8, "and quite different ones in this", "en", "a", 1)]
    return spark.createDataFrame(rows, DOC)


def test_drop_copies_keeps_every_column(odd):
    docs = odd
    for c in ("_n", "nth", "own", "row", "sha", "id", "_sha_own", "kept"):
        docs = docs.withColumn(c, F.concat(F.lit(c), F.col("lang")))
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    groups = {}
    for r in docs.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or ""), []).append(r)
    assert len(rows) == len(groups)
    for r in rows:
        own = groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")]
        assert r in own and r["_n"] == (None if r["lang"] is None else "_n" + r["lang"])
        best = min(own, key=lambda x: (-len(x["text"] or ""), x["doc_id"] is None, x["doc_id"] or 0))
        assert (len(r["text"] or ""), r["doc_id"]) == (len(best["text"] or ""), best["doc_id"])
    # rows that tie in id and text but differ elsewhere: the same one whatever the order of the rows
    again = exact_dedup.drop_copies(docs.orderBy(F.desc("n_chars")).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0


def test_one_document_of_each_component_stays(odd):
    docs = odd.withColumn("root", F.lit("clash")).withColumn("row_key", F.lit(1)).withColumn("component_id", F.lit("c"))
    got = simhash.drop_near_copies(docs)
    assert got.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    # copies without an id: one text of them (its repeated rows are one document); empty texts: the smallest id
    assert len({t for i, t in kept if i is None}) == 1
    assert [i for i, t in kept if not (t or "").strip()] == [5]
    groups = {(r["doc_id"], r["row_key"]): r["fingerprint"] for r in simhash.near_groups(odd).collect()}
    assert len({(i, t) for i, t in kept}) == len(set(groups.values()))          # nothing here links but equal fingerprints
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0


def test_pipeline_stages_take_odd_rows(spark, odd, sf_small):
    base = spark.read.parquet(f"{sf_small}/documents.parquet").select(*odd.columns)
    docs = base.unionByName(odd).withColumn("score", F.lit("clash")).withColumn("n", F.lit(0))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_small)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), sf_small).count() == 0, name
        only = stage(spark, docs.where("doc_id is null"), sf_small)
        assert only.columns == docs.columns and only.count() >= 1, name
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, docs, sf_small).count() == docs.count() and stage(spark, docs.limit(0), sf_small).count() == 0
