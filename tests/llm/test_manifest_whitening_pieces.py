"""Merkle manifest, embedding whitening and SentencePiece encoding against brute force, with hostile rows."""

import hashlib
import zlib

import numpy as np
import pytest

from tidemark.llm import merkle, pieces, queries, whitening

DOC = "doc_id long, source string, lang string, n_chars long, text string, tree string, at long, pos int, key string"


# ---- Merkle manifest ---------------------------------------------------------------------------------------------

def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def _runs(levels, p):
    for level in levels[:-1]:
        yield p % 16, level[p // 16 * 16:p // 16 * 16 + 16]
        p //= 16


def _manifest(rows):
    """Brute force: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, source, ...) rows."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees[s] = own, _levels([_leaf(r) for r in own])
    top = _levels([trees[s][1][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        own, levels = trees[s]
        for p, r in enumerate(own):
            steps = [*_runs(levels, p), *_runs(top, k)]
            proof = "".join(d for at, run in steps for i, d in enumerate(run) if i != at)
            folded = levels[0][p]
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                folded = _leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for at, run in steps:
                folded = _h("".join(run[:at] + [folded] + run[at + 1:]))
            out.append((r[0], levels[0][p], levels[-1][0], top[-1][0], _h(proof), folded, folded == top[-1][0]))
    return out


def test_van_emde_boas_addresses():
    for levels in range(1, 5):
        places = [int(merkle.address(levels, d, i)) for d in range(levels) for i in range(16 ** d)]
        assert sorted(places) == list(range(merkle.nodes_in(levels)))
    # the top half comes first, and each bottom subtree is one stretch
    assert merkle.address(4, 1, np.arange(16)).tolist() == list(range(1, 17))
    assert merkle.address(4, 2, 1) - merkle.address(4, 2, 0) == merkle.nodes_in(2)
    assert merkle.address(4, 3, 16) == merkle.address(4, 2, 1) + 1


def test_block_serves_runs():
    leaves = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(300)]
    block = merkle.Block.build(leaves, 3)
    again = merkle.Block.load(block.store.tobytes(), 300, 3)
    levels = [[x.hex() for x in leaves]]
    for _ in range(3):
        levels.append([_h("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    assert again.root().hex() == levels[3][0]
    for p in (0, 15, 16, 255, 256, 299):
        steps = list(again.steps(p))
        assert [(a, [run[i:i + 32].hex() for i in range(0, len(run), 32)]) for a, run in steps] == \
            [(p // 16 ** k % 16, levels[k][p // 16 ** (k + 1) * 16:][:16]) for k in range(3)]
        assert merkle.fold(leaves[p], merkle.unpack(merkle.pack(steps))) == again.root()


def _doc_rows():
    rows = [(i, f"s{i % 3}", "en", i * 7, f"Text Number {i}") for i in range(120)]
    rows += [(i, "hot", "de", None, f"Hot {i % 9}") for i in range(1000, 5200)]            # more than one block
    rows += [(7001, None, None, None, None), (7002, None, "en", 0, ""), (7003, "", "en", 3, "Émile ÀB Z"),
             (7004, "alone", "en", 1, "A" * 300_000), (None, "s1", "en", 2, "no id"), (None, "s1", "en", 2, "no id"),
             (7005, "s2", "fr", 1, "Twice"), (7005, "s2", "fr", 1, "Twice"), (7005, "s2", "fr", 1, "Other text"),
             (-5, "ä", "en", -1, "Minus"), (7006, "s0", "-", 1, "-")]
    return rows


def test_manifest_matches_brute_force(spark):
    rows = _doc_rows()
    docs = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], DOC).repartition(5)
    got = sorted((tuple(r) for r in merkle.manifest_proofs(docs).collect()), key=str)
    assert got == sorted(_manifest(rows), key=str)
    assert any(not r[-1] for r in got) and len({r[3] for r in got}) == 1


def test_manifest_of_one_and_of_none(spark):
    rows = [(1, "a", "en", 1, "One")]
    one = merkle.manifest_proofs(spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], DOC))
    assert [tuple(r) for r in one.collect()] == _manifest(rows)
    none = merkle.manifest_proofs(spark.createDataFrame([], DOC))
    assert none.count() == 0 and none.columns == one.columns


def test_manifest_of_many_sources(spark):
    rows = [(i, f"src {i % 300}", "en", i, f"T{i}") for i in range(900)]
    got = merkle.manifest_proofs(spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], DOC)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(_manifest(rows), key=str)


# ---- whitening ---------------------------------------------------------------------------------------------------

VEC = "vec_id long, embedding array<float>, label int, x string, n int"


def _check_whitening(got, vectors):
    """``got`` rows against dense eigenvectors of the exact integers; returns the number of components."""
    ok = {i: [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for i, v in vectors}
    fit = np.array(sorted(set(map(tuple, ok.values()))), dtype=np.int64)
    n, d = fit.shape
    sums = [int(s) for s in fit.sum(0)]
    mean = np.array([s // n for s in sums]) + np.array([s % n / n for s in sums])
    centred = fit - mean
    e, c = np.linalg.eigh(centred.T @ centred / n)
    e, c = e[::-1], c[:, ::-1]
    k = min(16, d, int((e > 1e-9 * e[0]).sum()))
    by = {}
    for r in got:
        by.setdefault(r["component"], {}).setdefault(r["vec_id"], []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    for j in range(k):
        rows = by[j + 1]
        assert sorted(rows) == sorted(ok)
        want = {i: (np.array(x) - mean) @ c[:, j] / np.sqrt(e[j]) for i, x in ok.items()}
        value = np.array([rows[i][0]["whitened"] for i in sorted(rows)])
        truth = np.array([want[i] for i in sorted(rows)])
        gap = min([abs(e[j] - x) for m, x in enumerate(e) if m != j], default=1)
        if gap > 1e-6 * e[0]:
            assert min(np.abs(value - truth).max(), np.abs(value + truth).max()) < 1e-6
        for i, r in ((i, r) for i, own in rows.items() for r in own):
            assert r["n"] == n and r["deviation"] == sum((n * x - s) ** 2 for x, s in zip(ok[i], sums))
            assert r["explained"] == pytest.approx(e[j] / e.sum(), rel=1e-9) and r["identity_error"] < 1e-8
    return k


def test_whitening_matches_dense_eigenvectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 24)) @ np.diag(1 / np.arange(1, 25) ** 0.7)
    vectors = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[7].tolist()) for i in range(200)]
    odd = [(2000, None), (2001, [None] + [0.0] * 23), (2002, [float("nan")] + [0.0] * 23), (2003, [float("inf")] * 24),
           (2004, [1.0] * 5), (2005, [])]
    df = spark.createDataFrame([(i, v, 1, "clash", 3) for i, v in vectors + odd], VEC).repartition(7)
    got = whitening.whiten(df).collect()
    assert len(got) == 600 * 16 and _check_whitening(got, vectors) == 16


def test_whitening_of_low_rank_and_repeated_eigenvalues(spark):
    # four directions of equal spread, nothing else: a single start vector sees only one of them
    vectors = [(2 * k + s, [float(4 * (1 - 2 * s)) if i == k else 0.0 for i in range(20)]) for k in range(4) for s in (0, 1)]
    df = spark.createDataFrame([(i, v, 1, "c", 1) for i, v in vectors], VEC)
    assert _check_whitening(whitening.whiten(df).collect(), vectors) == 4


def test_whitening_of_nothing(spark):
    def count(vectors):
        return whitening.whiten(spark.createDataFrame([(1, v, 1, "c", 1) for v in vectors], VEC)).count()
    assert count([]) == count([None]) == count([[1.0, 2.0]] * 3) == count([[]]) == 0


def test_deviation_beyond_long_is_null():
    centre = whitening.Centre(3, [10, 1 << 40])
    x = np.array([[3, 1 << 38], [4, (1 << 40) // 3]], dtype=np.int64)
    want = [(3 * 3 - 10) ** 2 + (3 * (1 << 38) - (1 << 40)) ** 2, (12 - 10) ** 2 + (3 * ((1 << 40) // 3) - (1 << 40)) ** 2]
    assert centre.deviations(x) == [None if w >= 1 << 63 else w for w in want] and want[0] >= 1 << 63


def test_whitening_query(spark, sf_check):
    table = queries.table(spark, sf_check, "embeddings")
    vectors = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    assert _check_whitening(queries.QUERIES["op12_embedding_whitening"](spark, sf_check).collect(), vectors) == 16


# ---- SentencePiece -----------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def model():
    import public_tokenizers
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def _encoded(model, rows):
    sp = pieces.processor(model)
    out = []
    for i, t in rows:
        ids = sp.encode(t or "", add_eos=True)
        out.append((i, len(ids), " ".join(map(str, ids)), sp.decode(ids)))
    return sorted(out, key=str)


ODD_TEXTS = [None, "", " ", "  ", "   a  b   ", "a\n\n b\t c\r\n", "▁x ▁▁ y▁", "ﬁ x　y ́e", "<s> </s> <unk> <0x41>",
             "\x00a \x01", "\U0001F600\U0001F468‍\U0001F469 x", "日本語 の テキスト", "x" * 5000, " " * 70 + "code" + " " * 17,
             "a " * 4000, "� ﻿b", "Die Straße -- naïve façade…"]


def test_pieces_match_library(spark, model, sf_small):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(3, "   a  b   "), (None, "no id here")]
    rows += [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame([(*r, "k", 1, "r") for r in rows], "doc_id long, text string, key string, codes int, rare string")
    got = pieces.encode_texts(docs, model)
    assert sorted(map(tuple, got.collect()), key=str) == _encoded(model, rows)
    assert pieces.encode_texts(docs.limit(0), model).count() == 0


def test_a_chunk_is_segmented_once(model):
    table = pieces.ChunkTable(pieces.processor(model), True)
    calls = []
    add = table.add
    table.add = lambda new: (calls.extend(new), add(new))
    for t in ODD_TEXTS:
        table(t or "")
        table(t or "")
    assert len(calls) == len(set(calls)) > 20


def test_full_table_is_emptied(spark, model, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_CHARS", 30)
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(100 + i, f"the word{i % 7} the w{i} of  the") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, pieces.encode_texts(docs, model).collect()), key=str) == _encoded(model, rows)


def test_unseparable_vocabulary_takes_whole_texts(spark, model, monkeypatch):
    assert pieces.separable(pieces.processor(model))
    monkeypatch.setattr(pieces, "separable", lambda sp: False)
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(50, "a  b")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, pieces.encode_texts(docs, model).collect()), key=str) == _encoded(model, rows)


def test_pieces_query(spark, model, sf_check):
    rows = [tuple(r) for r in queries.table(spark, sf_check, "documents").select("doc_id", "text").collect()]
    got = queries.QUERIES["op13_sentencepiece"](spark, sf_check)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        ((i, n, _h(ids), _h(decoded)) for i, n, ids, decoded in _encoded(model, rows)), key=str)
