"""Quality classifiers and upsert key rules on small inline inputs."""

import base64
import hashlib

from tidemark.operators import quality, upsert


def b32(text: str) -> str:
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_validate_store_classes(spark):
    good, other = b32("body"), b32("other")
    files = spark.createDataFrame(
        [(f"s/{good[:2]}/{good[2:4]}/{good}.zst", "body"), (f"s/{other[:2]}/{other[2:4]}/{other}.zst", "body"),
         ("s/misc/x.zst", "body"), (f"s/{good[:2]}/{good[2:4]}/{good}.zst", None)], "path string, body string")
    got = sorted(r.status for r in quality.validate_store(files).collect())
    assert got == ["invalid_digest", "io_error", "ok", "unexpected_path"]
    assert quality.invalid_files(quality.validate_store(files)).count() == 2


def test_check_incoming_outcomes(spark):
    stored, new = b32("a"), b32("b")
    incoming = spark.createDataFrame([(stored + ".zst", "a"), (new + ".zst", "b"), (new + ".zst", "zzz"),
                                      ("bad-name", "a")], "name string, body string")
    store = spark.createDataFrame([(stored,)], "digest string")
    got = {(r.name[:8], r.outcome, r.location is not None, r.actual is not None)
           for r in quality.check_incoming(incoming, store).collect()}
    assert got == {(stored[:8], "stored", False, False), (new[:8], "new", True, False),
                   (new[:8], "mismatch", False, True), ("bad-name", "error", False, True)}


def test_redirect_line_validation(spark):
    from tidemark.functions.urls import REDIRECT_HTML_HEAD, REDIRECT_HTML_TAIL
    url = "https://example.com/x"
    ok = b32(REDIRECT_HTML_HEAD + url + REDIRECT_HTML_TAIL)
    lines = spark.createDataFrame([("f", 1, ok, url), ("f", 2, ok, "https://example.com/y"), ("f", 3, "X", None)],
                                  "file string, line_no long, digest string, url string")
    assert [r.line_ok for r in quality.validate_redirect_lines(lines).orderBy("line_no").collect()] == [True, False, False]


def test_insert_patterns_two_keys(spark):
    table = spark.createDataFrame([("com,a)/", True, "a", 1)], "surt string, prefix boolean, slug string, sort_id int")
    batch = spark.createDataFrame([("com,a)/", True, "a2", 5),   # (surt, prefix) taken
                                   ("com,b)/", True, "b", 1),    # sort_id taken
                                   ("com,c)/", True, "c", 7), ("com,c)/", True, "c2", 9),  # clash in batch: 7 wins
                                   ("com,d)/", False, "d", 8)],
                                  "surt string, prefix boolean, slug string, sort_id int")
    got = sorted((r.slug, r.sort_id) for r in upsert.insert_patterns(table, batch).collect())
    assert got == [("c", 7), ("d", 8)]


def test_insert_success_idempotent(spark):
    table = spark.createDataFrame([(1, "D1", True)], "capture_id long, snapshot string, correct_digest boolean")
    batch = spark.createDataFrame([(1, "D1", True), (1, "D1", True), (2, "D2", False)],
                                  "capture_id long, snapshot string, correct_digest boolean")
    snaps = spark.createDataFrame([("D1",)], "digest string")
    rows, new_snaps = upsert.insert_success(table, batch, snaps)
    assert [(r.capture_id, r.snapshot) for r in rows.collect()] == [(2, "D2")]
    assert [r.digest for r in new_snaps.collect()] == ["D2"]
    again, _ = upsert.insert_success(table.unionByName(rows), batch, snaps)
    assert again.count() == 0


def test_fetched_bodies_are_hashed_before_they_meet_the_wanted(spark):
    wanted = spark.createDataFrame([("u", 1, b32("a")), ("u", 2, b32("b")), ("v", 1, b32("c")), (None, 1, b32("a"))],
                                   "url string, captured_at long, digest string")
    fetched = spark.createDataFrame([("u", 1, "a"), ("u", 1, "x"), ("u", 2, None), ("w", 1, "c"), (None, 1, "a")],
                                    "url string, captured_at long, body string")
    got = quality.fetched_check(wanted, fetched)
    join = got._jdf.queryExecution().optimizedPlan()
    while join.nodeName() != "Join":
        join = join.children().head()
    for side in (join.children().apply(0).output(), join.children().apply(1).output()):
        assert "body" not in [side.apply(k).name() for k in range(side.size())]
    rows = {(r.url, r.captured_at, r.expected, r.actual, r.match, r.location) for r in got.collect()}
    path = [f"{d[:2]}/{d[2:4]}/{d}.zst" for d in (b32("a"), b32("x"))]
    assert rows == {("u", 1, b32("a"), b32("a"), True, path[0]), ("u", 1, b32("a"), b32("x"), False, path[1]),
                    ("u", 2, b32("b"), None, None, None)}
