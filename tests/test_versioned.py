"""Versioned tables: insert-if-absent that opens only what may hold a key, replay, conflicts, compaction; and the search
index that replaces changed documents."""

import datetime as dt
import os
import re
import time
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.operators import search as srch
from tidemark.operators.versioned import Conflict, State, VersionedTable
from tidemark.plans import fixtures as fx
from tidemark.session import checkpoint_dir
from tidemark.sources import cdx
from tidemark.streaming.index import SearchIndex
from tidemark.streaming.ingest import captures_table, cdx_stream, ingest, upsert_batch

KEY = ["surt", "captured_at"]


@pytest.fixture
def path(spark):
    return checkpoint_dir(spark, f"t-versioned-{uuid.uuid4().hex}/table")


def rows(spark, lo, hi, value, site="a"):
    return spark.range(lo, hi).select(F.concat(F.lit(f"com,{site})/"), F.col("id").cast("string")).alias("surt"),
                                      F.col("id").alias("captured_at"), F.lit(value).alias("v"))


def test_first_write_wins_and_replays_change_nothing(spark, path):
    t = VersionedTable(spark, path, KEY, 8)
    assert t.read() is None and t.ledger.state() == State()
    t.insert_absent(rows(spark, 0, 3000, 1), "job", 0)
    t.insert_absent(rows(spark, 2990, 4000, 2), "job", 1)
    want = {1: 3000, 2: 1000}
    for again in ((rows(spark, 2990, 4000, 3), "job", 1), (rows(spark, 5000, 6000, 3), "job", 0), (rows(spark, 0, 4000, 3), "other", 0),
                  (rows(spark, 0, 10, 3), None, None)):
        t.insert_absent(*again)
        assert {r["v"]: r["n"] for r in t.read().groupBy("v").agg(F.count("*").alias("n")).collect()} == want
    assert t.ledger.state().applied == {"job": 1, "other": 0}
    state = t.compact()
    assert len(state.live) == 1 and t.read().count() == 4000 and t.ledger.state().applied == {"job": 1, "other": 0}
    t.insert_absent(rows(spark, 3999, 4002, 4))
    assert t.read().where("v = 4").count() == 2


def test_filters_never_miss_and_open_little(spark, path):
    t = VersionedTable(spark, path, KEY, 8)
    t.insert_absent(rows(spark, 0, 4000, 1))
    t.insert_absent(rows(spark, 10_000, 14_000, 1))
    state = t.ledger.state()
    own = rows(spark, 0, 20_000, 1)
    maybe = {(r["captured_at"], r["gen"]) for r in t.may_hold(own, state).collect()}
    held = {(r["captured_at"], r["gen"]) for r in t.read().collect()}
    assert held <= maybe and len(held) == 8000
    # other times, other sites: ranges rule them out; the same ranges, other keys: the Bloom segments do, but for a few
    assert t.may_hold(rows(spark, 20_000, 30_000, 1), state).count() == 0
    assert t.may_hold(rows(spark, 0, 4000, 1, "zz"), state).count() == 0
    assert t.may_hold(rows(spark, 0, 4000, 1, "a)/1"), state).count() < 100


def test_only_folders_that_may_hold_a_key_are_opened(spark, path):
    t = VersionedTable(spark, path, KEY, 8)
    t.insert_absent(rows(spark, 0, 4000, 1))
    t.insert_absent(rows(spark, 10_000, 14_000, 1))
    found = t.present(rows(spark, 10_005, 10_006, 1))
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)
    assert any(re.search(r"gen#\d+ = 00000002", f) and re.search(r"bucket#\d+ (=|IN) ", f) for f in filters), filters
    opened = {f.rsplit("/", 2)[0].rsplit("/", 1)[-1] + "/" + f.rsplit("/", 2)[1] for f in
              (r["file"] for r in t.read(t.ledger.state(), {t.ledger.state().live[1]: [3]})
               .select(F.input_file_name().alias("file")).distinct().collect())}
    assert len(opened) == 1 and next(iter(opened)).endswith("bucket=3")
    assert [(r["captured_at"], r["gen"]) for r in found.collect()] == [(10_005, t.ledger.state().live[1])]


def test_a_slower_writer_computes_its_batch_again(spark, path):
    t, other = VersionedTable(spark, path, KEY, 8), VersionedTable(spark, path, KEY, 8)
    t.insert_absent(rows(spark, 0, 100, 1))
    write, calls = t.write_generation, []

    def raced(new, gen):
        calls.append(gen)
        if len(calls) == 1:                       # another writer commits while this one writes
            other.insert_absent(rows(spark, 50, 200, 2))
        return write(new, gen)

    t.write_generation = raced
    t.insert_absent(rows(spark, 90, 300, 3))
    assert len(calls) == 2
    assert {r["v"]: r["n"] for r in t.read().groupBy("v").agg(F.count("*").alias("n")).collect()} == {1: 100, 2: 100, 3: 100}
    with pytest.raises(Conflict):
        t.ledger.commit(State(1))


def test_empty_batches_null_keys_and_one_hot_bucket(spark, path):
    t = VersionedTable(spark, path, KEY, 4)
    t.insert_absent(rows(spark, 0, 0, 1), "job", 0)
    assert t.read().count() == 0 and t.ledger.state().applied == {"job": 0}
    odd = spark.createDataFrame([(None, 1, 1), ("x", None, 1), ("", 0, 1)], "surt string, captured_at long, v int")
    t.insert_absent(odd)
    t.insert_absent(odd)
    assert t.read().count() == 5                  # a key with a null equals none, itself included


def test_replayed_microbatch(spark, sf_small):
    base = checkpoint_dir(spark, f"t-replay-{uuid.uuid4().hex}")
    cr = fx.crawl(spark, sf_small)
    cdx.write_pages(cr.where("page = 0").drop("page"), f"{base}/pages/run=0")
    ingest(spark, f"{base}/pages", f"{base}/table", f"{base}/ckpt")
    t = captures_table(spark, f"{base}/table")
    n, state = t.read().count(), t.ledger.state()
    # the stream dies after its commit but before its own checkpoint: the same epoch comes again
    pages = spark.read.text(f"{base}/pages", wholetext=True, recursiveFileLookup=True)
    file = F.col("_metadata.file_path")
    batch = pages.select(file.alias("file"), cdx.page_time(file).alias("page_ts"),
                         F.from_json("value", "array<array<string>>").alias("rows"))
    upsert_batch(batch, f"{base}/table", f"{base}/ckpt", state.applied[f"{base}/ckpt"])
    assert t.ledger.state() == state and t.read().count() == n == fx.captures(spark, sf_small).count()
    upsert_batch(batch, f"{base}/table")          # and without an epoch the keys are known
    assert t.read().count() == n
    assert cdx_stream(spark, f"{base}/pages").isStreaming


# ---- search index ------------------------------------------------------------------------------------------------

def _same(a, b):
    return sorted(map(tuple, a.select(*sorted(b.columns)).collect()), key=str) == \
        sorted(map(tuple, b.select(*sorted(b.columns)).collect()), key=str)


def test_changed_documents_replace_their_rows(spark, sf_small):
    base = checkpoint_dir(spark, f"t-index-{uuid.uuid4().hex}/index")
    docs = fx.search_docs(spark, sf_small)
    index = SearchIndex(spark, base)
    assert index.docs() is None and index.postings().count() == 0
    old = docs.where("year < 2021").withColumn("content", F.lit("stale words only")).withColumn(
        "captured_at", F.col("captured_at") - F.expr("INTERVAL 1 DAY"))
    index.apply(old, "s", 0)
    assert index.postings().where("token = 'stale'").count() == old.count() > 0
    index.apply(old.unionByName(docs), "s", 1)                    # both forms in one batch: the later one counts
    index.apply(old, "s", 1)                                      # replayed epoch
    rebuilt = srch.document_postings(docs)
    assert _same(index.postings().drop("shard"), rebuilt) and _same(index.docs(), docs)
    stats = spark.range(1).select(*[c.alias(k) for k, c in srch.field_stats(index.docs()).items()]).first()
    assert stats == spark.range(1).select(*[c.alias(k) for k, c in srch.field_stats(docs).items()]).first()
    q = srch.Query(should="the data")
    assert _same(srch.search_matches(index.docs(), index.postings(), q), srch.search_matches(docs, rebuilt, q))
    state = index.compact()
    assert len(state.live) == 1 and _same(index.postings().drop("shard"), rebuilt) and _same(index.docs(), docs)


def test_deleted_documents_go_and_may_come_back(spark, sf_small):
    base = checkpoint_dir(spark, f"t-index-{uuid.uuid4().hex}/index")
    docs = fx.search_docs(spark, sf_small)
    index = SearchIndex(spark, base)
    index.apply(docs)
    gone = docs.where("year % 2 = 0")
    index.apply(gone.withColumn("deleted", F.lit(True)))
    assert index.docs().count() == docs.count() - gone.count() and index.postings().join(gone, "snapshot").count() == 0
    index.apply(gone.withColumn("deleted", F.lit(None).cast("boolean")))
    assert _same(index.docs(), docs) and _same(index.postings().drop("shard"), srch.document_postings(docs))
    index.apply(docs.withColumn("deleted", F.lit(True)))
    index.compact()
    assert index.docs().count() == index.postings().count() == 0
    index.apply(docs.limit(1))
    assert index.docs().count() == 1


def test_only_generations_replaced_in_part_meet_their_marks(spark):
    base = checkpoint_dir(spark, f"t-index-{uuid.uuid4().hex}/index")

    def docs(ids, text):
        return spark.createDataFrame([(f"s{i}", dt.datetime(2020, 1, 1), f"title {i}", f"{text} words {text}") for i in ids],
                                     "snapshot string, captured_at timestamp, title string, content string")

    def held(tok):
        return sorted(r["snapshot"] for r in index.postings().where(F.col("token") == tok).collect())

    def joins(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Join")

    index = SearchIndex(spark, base)
    index.apply(docs(range(6), "old"))
    assert joins(index.postings()) == joins(index.docs()) == 0
    index.apply(docs(range(2), "new"))                            # replaced in part
    assert joins(index.postings()) == 1 and held("old") == ["s2", "s3", "s4", "s5"] and held("new") == ["s0", "s1"]
    index.apply(docs(range(6), "last"))                           # both wholly replaced
    assert joins(index.postings()) == joins(index.docs()) == 0 and held("old") == held("new") == []
    assert held("last") == [f"s{i}" for i in range(6)] and index.docs().count() == 6
    index.apply(docs([4], "gone").withColumn("deleted", F.lit(True)))
    index.compact()
    assert joins(index.postings()) == 0 and held("last") == ["s0", "s1", "s2", "s3", "s5"]
    assert _same(index.postings().drop("shard"), srch.document_postings(index.docs()))


def _texts(spark, ids, year=2020):
    from random import Random
    rows = [(f"s{i}", dt.datetime(year, 1, 1), f"title {i}", f"{Random(f'{year}-{i}').randbytes(10_000).hex()} w{year}") for i in ids]
    return spark.createDataFrame(rows, "snapshot string, captured_at timestamp, title string, content string")


def _held_beside(spark, index) -> int:
    """Bytes of shuffle files and of the checkpoint folder without the index."""
    jvm = spark.sparkContext._jvm
    tops = [d.getPath() for d in jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    total = 0
    for top in [*tops, checkpoint_dir(spark)]:
        for folder, _, names in os.walk(top):
            if not folder.startswith(os.path.dirname(index.path)):
                for n in names:
                    try:
                        total += os.path.getsize(f"{folder}/{n}")
                    except OSError:             # went meanwhile
                        pass
    return total


def _settled(spark, index, most) -> bool:
    end = time.time() + 20                      # files of a shuffle go in the background
    while _held_beside(spark, index) > most and time.time() < end:
        time.sleep(0.5)
    return _held_beside(spark, index) <= most


def test_an_applied_batch_leaves_its_texts_in_the_index_alone(spark):
    index = SearchIndex(spark, checkpoint_dir(spark, f"t-index-{uuid.uuid4().hex}/index"))
    before, size = _held_beside(spark, index), 200 * 20_000
    index.apply(_texts(spark, range(200)))
    assert _settled(spark, index, before + size // 4)
    index.apply(_texts(spark, range(100), 2021).withColumn("deleted", F.expr("snapshot < 's5'")))
    assert _settled(spark, index, before + size // 4)
    want = _texts(spark, range(100), 2021).where("snapshot >= 's5'").unionByName(_texts(spark, range(100, 200)))
    assert _same(index.docs().select("snapshot", "content"), want.select("snapshot", "content"))


def test_a_compaction_leaves_its_texts_in_the_index_alone(spark):
    index = SearchIndex(spark, checkpoint_dir(spark, f"t-index-{uuid.uuid4().hex}/index"))
    index.apply(_texts(spark, range(200)))
    index.apply(_texts(spark, range(20), 2021))
    before = _held_beside(spark, index)
    index.compact()
    assert _settled(spark, index, before + 200 * 20_000 // 4)
    want = _texts(spark, range(20), 2021).unionByName(_texts(spark, range(20, 200)))
    assert _same(index.docs().select("snapshot", "content"), want.select("snapshot", "content"))
    assert _same(index.postings().drop("shard"), srch.document_postings(want))


def test_a_batch_that_lost_the_race_is_applied_to_the_newer_state(spark):
    base = checkpoint_dir(spark, f"t-index-{uuid.uuid4().hex}/index")
    index, other = SearchIndex(spark, base), SearchIndex(spark, base)
    index.apply(_texts(spark, range(4)))
    write, calls = index._write, []

    def raced(gen, docs):
        calls.append(gen)
        if len(calls) == 1:
            other.apply(_texts(spark, [1, 2, 5], 2021))
        return write(gen, docs)

    index._write = raced
    last = _texts(spark, [0, 1, 3, 6], 2022)
    index.apply(last.withColumn("deleted", F.expr("snapshot = 's3'")))
    assert len(calls) == 2
    want = last.where("snapshot <> 's3'").unionByName(_texts(spark, [2, 5], 2021))
    assert _same(index.docs().select("snapshot", "content"), want.select("snapshot", "content"))
    assert _same(index.postings().drop("shard"), srch.document_postings(want))


def test_files_of_a_batch_go_when_the_index_holds_its_rows(spark, sf_small):
    from tidemark.plans.q_sources import _replaced_index
    index = _replaced_index(spark, sf_small)
    docs = os.path.join(os.path.dirname(index.path), "docs")
    assert [n for n in os.listdir(docs) if n.startswith("b=")] == []
    assert _same(index.docs().select("snapshot", "content"), fx.search_docs(spark, sf_small).select("snapshot", "content"))
