"""Decoders with an error channel, store listings, and the bulk import job (restart, duplicates, odd files)."""

import base64
import gzip
import hashlib
import os

import pytest
import zstandard

from tidemark.operators import bulk_import as imp
from tidemark.operators import quality as ql
from tidemark.sources import store as stg


def digest(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def put(root, path, data):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as f:
        f.write(data)


def z(body):
    return zstandard.ZstdCompressor().compress(body)


SKIPPABLE = (0x184D2A53).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"notes"


@pytest.mark.parametrize("data, body, error", [
    (z(b"one"), b"one", None),
    (z(b"one") + z(b"two" * 1000), b"one" + b"two" * 1000, None),
    (SKIPPABLE + z(b"x") + SKIPPABLE, b"x", None),
    (z(b""), b"", None),
    (b"", None, "empty file"),
    (z(b"abc" * 100)[:-3], None, "truncated frame"),
    (z(b"one") + z(b"two")[:-1], None, "truncated frame"),
    (z(b"one")[:4], None, "truncated frame"),
    (z(b"one") + b"tail", None, "trailing bytes"),
    (b"plain text", None, "not a zstd frame"),
    (SKIPPABLE[:-2], None, "truncated frame"),
    (bytes.fromhex("28B52FFD00FF"), None, "corrupt frame"),
])
def test_decode_zstd(data, body, error):
    got = stg.decode_zstd(data)
    assert got[0] == body and (got[1] == error or error == "corrupt frame" and got[1] is not None)


@pytest.mark.parametrize("data, body, error", [
    (gzip.compress(b"one"), b"one", None),
    (gzip.compress(b"one") + gzip.compress(b"\xff\x00"), b"one\xff\x00", None),
    (b"", None, "empty file"),
    (gzip.compress(b"abc" * 100)[:-4], None, "truncated member"),
    (gzip.compress(b"one") + b"tail", None, "trailing bytes"),
    (b"not gzip at all", None, "corrupt member"),
    (gzip.compress(b"abc")[:-8] + b"\0" * 8, None, "corrupt member"),
])
def test_decode_gzip(data, body, error):
    assert stg.decode_gzip(data) == (body, error)


def test_truncated_body_is_an_io_error_and_strays_are_kept(spark, tmp_path):
    root = str(tmp_path / "store")
    good, cut, wrong = b"good body", b"cut body" * 50, b"wrong body"
    d = [digest(x) for x in (good, cut, wrong)]
    put(root, f"{d[0][:2]}/{d[0][2:4]}/{d[0]}.zst", z(good[:4]) + z(good[4:]))
    put(root, f"{d[1][:2]}/{d[1][2:4]}/{d[1]}.zst", z(cut)[:-2])
    put(root, f"{d[2][:2]}/{d[2][2:4]}/{d[2]}.zst", z(b"other"))
    put(root, "README", b"x")
    put(root, f"{d[0][:2]}/{d[0]}.zst", z(good))
    rows = {r["path"]: r for r in ql.validate_store(stg.read_store_files(spark, root)).collect()}
    status = {p.rsplit("/", 1)[1][:32]: r["status"] for p, r in rows.items() if p.count("/") == 3}
    assert status == {d[0]: "ok", d[1]: "io_error", d[2]: "invalid_digest"}
    assert rows["/README"]["status"] == rows[f"/{d[0][:2]}/{d[0]}.zst"]["status"] == "unexpected_path" and len(rows) == 5
    assert rows[f"/{d[1][:2]}/{d[1][2:4]}/{d[1]}.zst"]["actual"] is None
    body = {r["digest"]: r for r in stg.read_bodies(spark, root).collect()}
    assert body[d[1]]["body"] is None and body[d[1]]["error"] == "truncated frame"


def _legacy(root):
    bodies = [b"alpha", b"beta \xff\xfe not utf-8", b"gamma" * 99]
    for b in bodies:
        put(root, f"{digest(b)[0]}/{digest(b)}.gz", gzip.compress(b))
    cut, off = b"delta" * 30, b"epsilon"
    put(root, f"{digest(cut)[0]}/{digest(cut)}.gz", gzip.compress(cut)[:-5])
    letter = "Q" if digest(off)[0] != "Q" else "R"
    put(root, f"{letter}/{digest(off)}.gz", gzip.compress(off))
    put(root, "top.gz", b"x")
    put(root, "9/y.gz", b"x")
    put(root, f"{digest(off)[0]}/{digest(off)[0]}HORT.gz", gzip.compress(off))
    return bodies


def _rows(m):
    return sorted((r["path"], r["outcome"], r["reason"], r["written_bytes"] is not None) for r in m.collect())


def test_legacy_import_names_every_file(spark, tmp_path):
    src, store = str(tmp_path / "legacy"), str(tmp_path / "new")
    bodies = _legacy(src)
    m = imp.run_import(spark, src, store, "a", "legacy")
    rows = {r["path"]: r for r in m.collect()}
    assert len(rows) == 8 and m.columns == imp.MANIFEST
    assert sorted(r["digest"] for r in rows.values() if r["outcome"] == "written") == sorted(map(digest, bodies))
    assert sorted(r["reason"] for r in rows.values() if r["outcome"] == "rejected") == [
        "folder", "folder", "letter", "name", "truncated member"]
    held = {r["digest"]: bytes(r["body"]) for r in stg.read_bodies(spark, store).collect()}
    assert held == {digest(b): b for b in bodies}
    # again under the same name: the same manifest; under a new one: all of them stored, nothing written
    assert _rows(imp.run_import(spark, src, store, "a", "legacy")) == _rows(m)
    again = imp.run_import(spark, src, store, "b", "legacy")
    assert again.where("outcome = 'written'").count() == 0 and again.where("reason = 'stored'").count() == 3


def test_interrupted_import_is_finished_as_if_it_had_not_stopped(spark, tmp_path):
    src = str(tmp_path / "legacy")
    _legacy(src)
    whole = imp.run_import(spark, src, str(tmp_path / "one"), "x", "legacy")
    store = str(tmp_path / "two")
    plan = imp.plan_import(stg.scan_candidates(spark, src, "legacy"), imp.stored_digests(spark, store))
    plan.write.parquet(f"{store}/_imports/x/plan")
    # the run dies after some bodies are in the store, before its second stage is committed
    some = spark.read.parquet(f"{store}/_imports/x/plan").where("outcome = 'candidate'").orderBy("path").limit(2)
    assert imp.write_candidates(some, src, store, "legacy").count() == 2
    assert imp.manifest(spark, store, "x").where("outcome = 'candidate'").count() == 4
    assert _rows(imp.run_import(spark, src, store, "x", "legacy")) == _rows(whole)


def test_files_of_one_digest(spark, tmp_path):
    src = str(tmp_path / "flat")
    body = b"the body"
    d = digest(body)
    put(src, f"{d}-00.gz", gzip.compress(body)[:-1])
    put(src, f"{d}-01.gz", gzip.compress(b"something else"))
    for i in range(2, 40):
        put(src, f"{d}-{i:02d}.gz", gzip.compress(body))
    got = {r["path"]: (r["outcome"], r["reason"]) for r in imp.run_import(spark, src, str(tmp_path / "s"), "v", "gzip").collect()}
    assert got[f"{d}-00.gz"] == ("rejected", "truncated member") and got[f"{d}-01.gz"] == ("rejected", "digest")
    assert got[f"{d}-02.gz"] == ("written", None)
    assert sum(v == ("skipped", "duplicate") for v in got.values()) == 37
    # without the check the first readable file is filed under its name, and validation finds it
    loose = imp.run_import(spark, src, str(tmp_path / "t"), "v", "gzip", verify=False)
    assert {r["path"]: r["outcome"] for r in loose.collect()}[f"{d}-01.gz"] == "written"
    assert [r["status"] for r in ql.validate_store(stg.read_store_files(spark, str(tmp_path / "t"))).collect()] == ["invalid_digest"]


def test_redirects_are_left_out_and_empty_sources_have_empty_manifests(spark, tmp_path):
    src = str(tmp_path / "plain")
    for b in (b"a", b"b"):
        put(src, digest(b), b)
    known = spark.createDataFrame([(digest(b"a"),)] * 3, "digest string")
    m = imp.run_import(spark, src, str(tmp_path / "s"), "r", "plain", known)
    assert {(r["digest"], r["outcome"], r["reason"]) for r in m.collect()} == {
        (digest(b"a"), "skipped", "redirect"), (digest(b"b"), "written", None)}
    os.makedirs(tmp_path / "none")
    assert imp.run_import(spark, str(tmp_path / "none"), str(tmp_path / "s"), "n", "plain").count() == 0
    with pytest.raises(ValueError):
        imp.run_import(spark, src, str(tmp_path / "s"), "w", "tar")


def test_legacy_bodies_are_bytes_and_prefixes_read_one_folder(spark, tmp_path):
    src = str(tmp_path / "legacy")
    bodies = _legacy(src)
    rows = stg.read_legacy_bodies(spark, src).collect()
    assert {bytes(r["body"]) for r in rows if r["body"] is not None} == set(bodies)
    assert [r["text"] for r in rows if r["digest"] == digest(bodies[1])] == [None]
    assert len(rows) == 8 and sum(r["reject"] is not None for r in rows) == 4
    first = digest(bodies[0])
    own = stg.read_legacy_bodies(spark, src, first[:3])
    assert [r["digest"] for r in own.where("reject IS NULL").collect()] == [first]
    with pytest.raises(ValueError):
        stg.read_legacy_bodies(spark, src, "a1")


def test_listing_and_reading_take_as_many_tasks_as_the_session_has_not_as_there_are_files(spark, tmp_path):
    import zstandard
    names = [base64.b32encode(hashlib.sha1(str(i).encode()).digest()).decode() for i in range(600)]
    for i, d in enumerate(names):
        (tmp_path / d[:2] / d[2:4]).mkdir(parents=True, exist_ok=True)
        (tmp_path / d[:2] / d[2:4] / f"{d}.zst").write_bytes(zstandard.compress(str(i).encode()))
    for read in (stg.read_bodies(spark, str(tmp_path)), stg.read_store_files(spark, str(tmp_path)), stg.list_files(spark, str(tmp_path))):
        assert read.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {r["digest"]: r["text"] for r in stg.read_bodies(spark, str(tmp_path)).collect()}
    assert got == {d: str(i) for i, d in enumerate(names)}


def test_listing_shows_the_files_that_sparks_own_listing_shows(spark, tmp_path):
    for n in ("a/x.zst", "a/_h/y.zst", "a/empty.zst", "_q/z.zst", ".h.zst", "a/_metadata", "b/k=_1", "a/c._COPYING_", "top.zst",
              "_k=1/u.zst", "a b/s p.zst", "a/é%20.zst"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"" if "empty" in n else b"12")
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).select("path", "length")
    want = sorted((r["path"].split(f"{tmp_path}/")[1], r["length"]) for r in plain.collect())
    listed = stg.list_files(spark, str(tmp_path))
    (tmp_path / "later").write_bytes(b"x")                  # the listing is of the moment it was asked for
    assert sorted((r["path"], r["length"]) for r in listed.collect()) == want
    assert sorted(r["path"] for r in stg.list_store(spark, str(tmp_path)).collect()) == sorted(
        r["path"] for r in plain.collect() if r["path"].endswith(".zst"))


def test_bodies_read_are_not_broadcast(spark, tmp_path):
    bodies = [bytes([65 + i]) * 1000 for i in range(20)]
    for b in bodies:
        put(str(tmp_path), f"{digest(b)[:2]}/{digest(b)[2:4]}/{digest(b)}.zst", z(b))
    listed = stg.list_store(spark, str(tmp_path)).select("path", "digest")
    for j in (listed.join(stg.read_bodies(spark, str(tmp_path)).select("path", "text"), "path"),
              listed.join(stg.read_store_files(spark, str(tmp_path)).select("path", "body"), "path", "left")):
        # nothing says how large the bodies are, so the plan may not take them for small
        assert "Broadcast" not in j._jdf.queryExecution().sparkPlan().toString()
    got = {r["digest"]: r["text"] for r in listed.join(stg.read_bodies(spark, str(tmp_path)).select("path", "text"), "path").collect()}
    assert got == {digest(b): b.decode() for b in bodies}
