"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are words and their leading prefixes (inflected and compound forms share a prefix). The labelled rows choose the
terms that tell the classes apart (a significance test, no fixed number); inverse document frequencies come
from all documents. A bounded sample of labelled rows is the example set; its vectors are an inverted index whose
postings are cut into blocks of examples with the largest weight of each term per block. A query scores blocks in order
of their upper bound and stops when no block can beat the k-th neighbour, so the neighbours are exact. Votes weighted
by closeness are calibrated on the examples themselves, each left out of its own vote.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, row_key, summed, without, written

#: Most labelled rows used as examples (those with the smallest hash of their id): bounds the index every task holds.
EXAMPLES = 12_000
#: Chi-square value from which a term counts as telling (about one false term in a million tests).
SIGNIFICANT = 24.0
#: A term must occur in this many examples.
MIN_EXAMPLES = 4
NEIGHBOURS = 15
#: Prior votes added to every neighbourhood, and lengths of the prefixes in bytes.
PRIOR, PREFIXES = 0.5, range(4, 13)
BLOCK = 64
_CACHE = 200_000

_SEP = bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
_TABLE = bytes.maketrans(_SEP, b" " * len(_SEP))


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words of letters, digits and non-ASCII characters."""
    return text.lower().translate(_TABLE).split()


def terms_of(word: bytes) -> list[bytes]:
    """The word and its leading prefixes, marked ``word`` and ``prefix*``; prefixes end between characters."""
    return [word] + [word[:n] + b"*" for n in PREFIXES if n < len(word) and word[n] & 0xC0 != 0x80]


class TermCounter:
    """Counts of the known terms in a text; what a word contributes is remembered for the recent words."""

    def __init__(self, terms: list[bytes]):
        self.index = {t: i for i, t in enumerate(terms)}
        self.heads = {t[:PREFIXES[0]] for t in terms}       # a word that begins like no term has none
        self.seen: dict[bytes, tuple] = {}

    def __call__(self, text: bytes) -> dict[int, int]:
        counts: dict[int, int] = {}
        seen, index, heads, head = self.seen, self.index, self.heads, PREFIXES[0]
        if len(seen) > _CACHE:
            seen.clear()
        for w in words(text):
            hit = seen.get(w)
            if hit is None:
                if w[:head] not in heads:
                    continue
                hit = seen[w] = tuple(index[t] for t in terms_of(w) if t in index)
            for i in hit:
                counts[i] = counts.get(i, 0) + 1
        return counts


def choose_terms(examples: DataFrame) -> list[str]:
    """Terms of the labelled rows (text, label) whose document frequency differs between the classes. Rows of equal
    text and label are one piece of evidence, so a copied text can't vote its whole vocabulary in."""
    examples = examples.select("text", "label").distinct()

    def run(batches):
        for b in batches:
            held: dict[bytes, list[int]] = {}
            for text, label in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist()):
                for t in {t for w in set(words(text)) for t in terms_of(w)}:
                    c = held.setdefault(t, [0, 0])
                    c[0] += 1
                    c[1] += label
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()), pa.array([c[0] for c in held.values()], pa.int64()),
                 pa.array([c[1] for c in held.values()], pa.int64())], names=["term", "df", "a"])

    n, pos = examples.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n or pos in (0, n):
        return []
    a, df, neg = F.col("a"), F.col("df"), n - pos
    diff = a * neg - (df - a) * pos
    chi = n * diff * diff / (df * (n - df) * float(pos) * float(neg))
    found = (examples.mapInArrow(run, "term binary, df long, a long")
             .groupBy("term").agg(F.sum("df").cast("double").alias("df"), F.sum("a").cast("double").alias("a"))
             .where((df >= MIN_EXAMPLES) & (df < n)).where(chi >= SIGNIFICANT).select("term"))
    return sorted(bytes(r[0]) for r in found.collect())   # bounded: terms of at most EXAMPLES rows


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... (``size`` of them) of every range, one range after the other."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


class BlockMaxIndex:
    """Inverted index over unit vectors, with the largest weight per term and block of ``BLOCK`` examples."""

    def __init__(self, vectors: list[dict[int, float]], n_terms: int):
        n = len(vectors)
        self.n_blocks = max(1, -(-n // BLOCK))
        lists: list[list[tuple[int, float]]] = [[] for _ in range(n_terms)]
        for e, v in enumerate(vectors):
            for t, w in v.items():
                lists[t].append((e, w))
        # postings of all terms one after the other, cut into runs of one term and block
        ids = np.array([e for p in lists for e, _ in p], dtype=np.int64)
        self.weights = np.array([w for p in lists for _, w in p], dtype=float)
        term = np.repeat(np.arange(n_terms), [len(p) for p in lists])
        new = np.r_[True, (np.diff(term) > 0) | (np.diff(ids // BLOCK) > 0)] if len(ids) else np.empty(0, bool)
        self.starts = np.flatnonzero(new)
        self.sizes = np.diff(np.r_[self.starts, len(ids)])
        self.lane, self.blocks = ids % BLOCK, ids[self.starts] // BLOCK
        self.maxima = np.maximum.reduceat(self.weights, self.starts) if len(ids) else np.empty(0)
        self.runs = np.searchsorted(term[self.starts], np.arange(n_terms + 1))      # first run of each term

    def search(self, query: dict[int, float], k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine above zero, ties to the smaller example number, ``skip`` left out."""
        terms = np.fromiter(query, np.int64, len(query))
        n_runs = self.runs[terms + 1] - self.runs[terms]
        runs = _ranges(self.runs[terms], n_runs)
        blocks, q = self.blocks[runs], np.repeat(np.fromiter(query.values(), float, len(query)), n_runs)
        bound = np.bincount(blocks, q * self.maxima[runs], self.n_blocks)
        order = np.flatnonzero(bound > 0)
        order = order[np.argsort(-bound[order], kind="stable")]
        best_e, best_s = np.empty(0, np.int64), np.empty(0)
        at, step = 0, 8
        while at < len(order):
            if len(best_s) >= k and bound[order[at]] < best_s[k - 1] - 1e-12:
                break
            row = np.full(self.n_blocks, -1)
            batch = order[at:at + step]
            row[batch] = np.arange(len(batch))
            at += step
            step *= 4
            held = row[blocks]
            hit = np.flatnonzero(held >= 0)
            size = self.sizes[runs[hit]]
            own = _ranges(self.starts[runs[hit]], size)
            score = np.bincount(np.repeat(held[hit] * BLOCK, size) + self.lane[own],
                                np.repeat(q[hit], size) * self.weights[own], len(batch) * BLOCK)
            r = np.flatnonzero(score)
            e = batch[r // BLOCK] * BLOCK + r % BLOCK
            s = score[r]
            if skip >= 0:
                s, e = s[e != skip], e[e != skip]
            best_e, best_s = np.r_[best_e, e], np.r_[best_s, s]
            top = np.lexsort((best_e, -np.round(best_s, 12)))[:k]
            best_e, best_s = best_e[top], best_s[top]
        return best_e, best_s


def unit_vector(counts: dict[int, int], idf: np.ndarray) -> dict[int, float]:
    v = {t: (1.0 + math.log(n)) * float(idf[t]) for t, n in sorted(counts.items())}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {t: x / norm for t, x in v.items()} if norm > 0 else {}


class Scorer:
    """Calibrated distance-weighted votes of the nearest examples."""

    def __init__(self, example_ids, labels, counts, idf):
        self.ids, self.labels, self.idf = np.array(example_ids, dtype=np.int64), np.array(labels, dtype=float), idf
        vectors = [unit_vector(c, idf) for c in counts]
        self.index = BlockMaxIndex(vectors, len(idf))
        self.prior = float(self.labels.mean()) if len(self.labels) else 0.5
        bare = np.array([not v for v in vectors], dtype=bool)
        self.bare_ids = np.flatnonzero(bare)
        # examples without a telling term are each other's neighbours, at equal distance
        self.bare_votes = float(self.labels[bare].sum())
        raw = np.array([self.vote(v, e)[0] for e, v in enumerate(vectors)])
        self.steps = isotonic(raw, self.labels)

    def vote(self, vector: dict[int, float], skip: int = -1):
        if not vector:
            own = [self.labels[skip]] if skip >= 0 else []
            raw = (self.bare_votes - sum(own) + PRIOR * self.prior) / (len(self.bare_ids) - len(own) + PRIOR)
            return raw, self.bare_ids[:NEIGHBOURS], np.zeros(len(self.bare_ids[:NEIGHBOURS]))
        e, s = self.index.search(vector, NEIGHBOURS, skip)
        weight = 1.0 / (1.0 - np.minimum(s, 1.0) + 0.1)
        return (float((weight * self.labels[e]).sum() + PRIOR * self.prior) / (weight.sum() + PRIOR)), e, s

    def __call__(self, counts: dict[int, int]):
        raw, e, s = self.vote(unit_vector(counts, self.idf))
        at, value = self.steps
        score = float(np.interp(raw, at, value)) if len(at) else raw
        return min(max(score, 0.0), 1.0), self.ids[e].tolist(), s.tolist()


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of y on x: knots (mean x, value), values smoothed by one prior observation."""
    if len(x) == 0:
        return np.empty(0), np.empty(0)
    weight = np.ones(len(x)) if weight is None else weight
    prior = float((y * weight).sum() / weight.sum())
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for i in order:
        pools.append([x[i] * weight[i], y[i] * weight[i], weight[i]])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], np.maximum.accumulate((p[:, 1] + prior) / (p[:, 2] + 1.0))


def smallest_hashes(known: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows of smallest hash of their doc_id (ties: smaller id). A cut-off at one and a half times the
    share that is wanted keeps all but about that many rows away from the merging task; if chance leaves too few
    below it, there is no cut-off."""
    h = F.xxhash64("doc_id")
    n = known.count()
    if n > 1.5 * most:
        below = known.where(F.shiftrightunsigned(h, 32) < int(1.5 * most / n * 2 ** 32))      # upper half, unsigned
        if below.count() >= most:
            known = below
    return known.orderBy(F.shiftrightunsigned(h, 32), h, "doc_id").limit(most)


def score_toxicity(docs: DataFrame, labelled: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, score (0 to 1), neighbours (doc_ids of the evidence) and
    their similarities.

    ``labelled`` (doc_id, label 0/1) names the rows to learn from; at most ``examples`` of them (smallest hash of the id)
    are read. Null texts are empty; a text without telling terms is voted on by the examples that have none either.
    Without labelled rows every score is 0.5, with one class only its smoothed rate. Labels that are null,
    repeated or of unknown documents are skipped or counted once; ties between neighbours go to the smaller example.
    A null doc_id is scored like any other row, but teaches nothing. An empty table gives no rows."""
    d = documents(docs, row_key().alias("row_key"))
    known = (labelled.where("doc_id is not null and label is not null")
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("label").cast("int").alias("label")))
    known_sample = written(smallest_hashes(written(known.join(d.select("doc_id"), "doc_id", "left_semi")), examples))
    chosen = written(d.drop("row_key").join(F.broadcast(known_sample), "doc_id")          # at most ``examples`` rows
                     .groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    terms = choose_terms(chosen)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(terms)

    def count(batches):
        counter = TermCounter(shared.value)
        for b in batches:
            found = [counter(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([list(c) for c in found], pa.list_(pa.int32())),
                 pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))],
                names=["doc_id", "row_key", "terms", "counts"])

    schema = "doc_id long, row_key long, terms array<int>, counts array<int>"
    vectors = written(d.mapInArrow(count, schema))
    n_terms = len(terms)
    *df, n = summed(vectors.select("terms"), lambda b: np.r_[np.bincount(b.column(0).flatten(), minlength=n_terms), b.num_rows],
                    n_terms + 1)
    df = np.array(df)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    rows = chosen.select("doc_id", "text", F.lit(0).cast("long").alias("row_key")).mapInArrow(count, schema).join(F.broadcast(known_sample), "doc_id").orderBy("doc_id").collect()
    model = sc.broadcast(Scorer([r["doc_id"] for r in rows], [r["label"] for r in rows],
                                [dict(zip(r["terms"], r["counts"])) for r in rows], idf))

    def score(batches):
        scorer = model.value
        cache: dict[tuple, tuple] = {}
        for b in batches:
            out = []
            for t, c in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                key = (tuple(t), tuple(c))
                if key not in cache:
                    if len(cache) > _CACHE:
                        cache.clear()
                    cache[key] = scorer(dict(zip(t, c)))
                out.append(cache[key])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([o[0] for o in out], pa.float64()),
                 pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.float64()))],
                names=["doc_id", "row_key", "score", "neighbours", "similarities"])

    return vectors.mapInArrow(score, "doc_id long, row_key long, score double, neighbours array<long>, "
                                     "similarities array<double>")


def drop_toxic(docs: DataFrame, labelled: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score is ``threshold`` or more; all columns kept, whatever their names. Rows that
    repeat an id and text share their score and go or stay together; null and empty texts are scored like any other.
    Where no row of ``docs`` is labelled nothing is known of any, and all stay. An empty table stays empty."""
    taught = (labelled.where("doc_id is not null and label is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
              .join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi"))
    if taught.isEmpty():
        return docs
    return without(docs, score_toxicity(docs, labelled).where(F.col("score") >= threshold))
