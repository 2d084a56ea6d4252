"""Stored layouts: bucketed captures joined without a shuffle, lookups as pushed filters, prefix folders."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.operators import reconcile as rc
from tidemark.operators import search as srch
from tidemark.plans import fixtures as fx
from tidemark.session import checkpoint_dir
from tidemark.sources import cdx, clustered as cl, store as stg


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_capture_joins_need_no_shuffle(spark, sf_small, no_broadcast):
    c, s, p = (f(spark, sf_small) for f in (fx.captures, fx.success, fx.pattern_entry))
    joined = c.join(s.select("capture_id", "snapshot"), "capture_id").join(p.select("capture_id", "slug"), "capture_id")
    assert "Exchange" not in _plan(joined) and _plan(joined).count("Bucketed: true") == 3
    info = _plan(rc.snapshot_info(c, s, p, fx.patterns(spark, sf_small)))
    assert "Exchange hashpartitioning(capture_id" not in info
    assert joined.count() == c.drop("x").join(s.select("capture_id"), "capture_id").join(p.select("capture_id"), "capture_id").count()


def test_lookups_reach_the_scan(spark, sf_small):
    c = fx.captures(spark, sf_small)
    key = c.select("surt").first()["surt"]
    assert f"EqualTo(surt,{key})" in _plan(cdx.lookup(c, key, True))
    assert "StringStartsWith(surt," in _plan(cdx.lookup(c, key[:12], False))
    top = spark.createDataFrame([(key, 1)], "surt string, rank int")
    assert f"EqualTo(surt,{key})" in _plan(srch.surt_timeline(top, fx.success(spark, sf_small), surts=[key]))
    # every bucket's file is sorted by SURT, so its row groups hold ranges
    rows = (c.select("surt", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).collect())
    by = {}
    for r in sorted(rows, key=lambda r: (r["f"], r["i"])):
        by.setdefault(r["f"], []).append(r["surt"])
    assert len(by) > 1 and all(v == sorted(v) for v in by.values())


def test_layout_survives_a_lost_catalogue(spark, sf_small):
    c = fx.captures(spark, sf_small)
    n = c.count()
    path = re.search(r"(file:\S+?/captures-\d+)\]", _plan(c)).group(1)
    spark.sql(f"DROP TABLE IF EXISTS {cl._table_name(path)}")
    again = cl.open_bucketed(spark, path, ["capture_id"], ["surt", "captured_at"], 8)
    assert again.count() == n and again.schema == c.schema


@pytest.mark.parametrize("levels", [(2, 2), (1,), (2,)])
def test_prefix_folders(spark, levels):
    digests = [a + b + c + "2" * 29 for a in "A2Z" for b in "B3" for c in "C4"] + [None]
    path = checkpoint_dir(spark, f"t-prefix-{uuid.uuid4().hex}")
    cl.write_by_prefix(spark.createDataFrame([(d, i) for i, d in enumerate(digests)], "digest string, n int"), path, levels=levels, files=3)
    for prefix in ("A", "2", "A3", "Z3C", "2B42", "A3C222", digests[5], "Q"):
        rows = cl.read_by_prefix(spark, path, prefix, levels=levels)
        assert sorted(r["digest"] for r in rows.collect()) == sorted(d for d in digests if d and d.startswith(prefix))
        assert re.search(r"PartitionFilters: \[[^\]]*p0", _plan(rows))
    assert cl.read_by_prefix(spark, path, levels=levels).count() == len(digests)


def test_prefix_lists_only_its_folders(spark, tmp_path):
    names = ["AB" + "CD" + "2" * 28, "AB" + "CE" + "3" * 28, "AC" + "CD" + "4" * 28, "2B" + "CD" + "5" * 28]
    for d in names:
        (tmp_path / d[:2] / d[2:4]).mkdir(parents=True, exist_ok=True)
        (tmp_path / d[:2] / d[2:4] / f"{d}.zst").write_bytes(b"x")
    (tmp_path / "AB" / "CD" / "ABCDnotes.txt").write_bytes(b"x")
    for prefix in ("A", "AB", "ABC", "ABCD", "ABCD2", names[1], "7"):
        want = sorted(d for d in names if d.startswith(prefix))
        if want:
            got = stg.list_files(spark, str(tmp_path), prefix=prefix)
            assert sorted(r["path"][-36:-4] for r in got.collect()) == want
    assert stg.prefix_glob("ABC") == "AB/C?/ABC*.zst"
    with pytest.raises(ValueError):
        stg.prefix_glob("ab")


def test_a_capture_looks_up_only_the_lengths_of_its_host(spark):
    from tidemark.operators.patterns import assign_patterns, prefix_lookups
    hosts = [f"com,h{i}" for i in range(40)]
    pats = [(f"{h})/{'x' * (k + i)}", True, f"{h}-{k}", i) for i, h in enumerate(hosts) for k in range(2)]     # 41 lengths in all
    p = spark.createDataFrame(pats + [("com,h1", True, "bare", 99)], "surt string, prefix boolean, slug string, sort_id int")
    caps = spark.createDataFrame([(i, f"{h})/{'x' * 60}") for i, h in enumerate(hosts)] + [(99, "org,none)/x")], "capture_id long, surt string")
    caps = caps.withColumn("captured_at", F.lit(None).cast("timestamp"))
    rows = prefix_lookups(caps, p.withColumnRenamed("surt", "p_surt"))
    assert rows.groupBy("capture_id").count().agg(F.max("count")).first()[0] == 3 and rows.count() == 40 * 3 + 1
    got = sorted((r["slug"], r["capture_id"]) for r in assign_patterns(caps, p).collect())
    assert got == sorted([(f"{h}-{k}", i) for i, h in enumerate(hosts) for k in range(2)]
                         + [("bare", i) for i, h in enumerate(hosts) if h.startswith("com,h1")])
