"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of whole texts come from one Arrow-batched pass. Random Fourier features approximate a Gaussian kernel over
the standardised statistics. Each task sums the normal equations of its labelled rows; Spark adds the sums cell by
cell, so what reaches the driver is one matrix whose size is the number of features squared, at any input size. Scores
are calibrated by an isotonic fit over score bins summed the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, written

FEATURES, RIDGE, SEED = 192, 1.0, 11
#: Kernel width in units of the square root of the number of statistics.
WIDTH = 0.7
BINS = 2048
_MARKS = b".,;:!?|#$%&*@<>{}[]()/\\\"'-_=+~^"
STATISTICS = ("log_bytes", "log_words", "log_lines", "mean_word", "upper", "lower", "digit", "space", "high",
              "entropy", "line_length", "distinct_bytes", *(f"mark_{c:02x}" for c in _MARKS), "longest_run",
              "distinct_words", "distinct_lines")


def statistics(text: bytes) -> np.ndarray:
    """Fixed list of statistics of one text; all zero for an empty one."""
    out = np.zeros(len(STATISTICS))
    if not text:
        return out
    n = len(text)
    buf = np.frombuffer(text, dtype=np.uint8)
    count = np.bincount(buf, minlength=256)
    share = count / n
    words = text.split()
    lines = text.split(b"\n")
    held = share[share > 0]
    out[:12] = (np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), (n - count[32]) / max(len(words), 1),
                share[65:91].sum(), share[97:123].sum(), share[48:58].sum(), share[9:14].sum() + share[32],
                share[128:].sum(), -(held * np.log2(held)).sum(), np.log1p(n / len(lines)), (count > 0).sum() / 256)
    marks = np.frombuffer(_MARKS, dtype=np.uint8)
    out[12:12 + len(marks)] = np.sqrt(share[marks])
    change = np.flatnonzero(np.diff(buf)) + 1
    out[-3] = np.log1p(np.diff(np.r_[0, change, n]).max())
    out[-2] = len(set(words)) / max(len(words), 1)
    out[-1] = len(set(lines)) / len(lines)
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats array) of every row."""
    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            flat = np.concatenate([statistics(t) for t in texts]) if texts else np.empty(0)
            ends = np.arange(len(texts) + 1, dtype=np.int32) * len(STATISTICS)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "stats"])

    return documents(docs).mapInArrow(run, "doc_id long, stats array<double>")


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Features:
    """Random Fourier features of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.Generator(np.random.PCG64(SEED))
        d = len(mean)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.project = rng.standard_normal((d, FEATURES)) / (WIDTH * np.sqrt(d))
        self.shift = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.project + self.shift), np.ones((len(z), 1))])


def _summed(rows: DataFrame, cells, width: int) -> np.ndarray:
    """Sum over all rows of ``cells(batch)`` (a vector of ``width``): one vector per task, added up by Spark."""
    def run(batches):
        total = np.zeros(width)
        for b in batches:
            total += cells(b)
        keep = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keep.astype(np.int32)), pa.array(total[keep])], names=["cell", "part"])

    out = np.zeros(width)
    for r in rows.mapInArrow(run, "cell int, part double").groupBy("cell").agg(F.sum("part").alias("total")).collect():
        out[r["cell"]] = r["total"]
    return out


def pool_adjacent(mean: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of bin labels on bin scores: (knot scores, values), one prior observation per pool."""
    prior = float((label * weight).sum() / weight.sum())
    pools: list[np.ndarray] = []
    for x, y, w in zip(mean, label, weight):
        pools.append(np.array([x * w, y * w, w]))
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = pools[-1] + last
    p = np.array(pools)
    return p[:, 0] / p[:, 2], np.maximum.accumulate((p[:, 1] + prior) / (p[:, 2] + 1))


def score_quality(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1, the calibrated chance of label 1).

    ``labelled`` (doc_id, label 0/1) names the rows to learn from; all of them are used. Null texts are empty, and an
    empty text is scored by its (zero) statistics. Without labelled rows every score is 0.5; with one class only its
    rate. Null, repeated or unknown labels are skipped or counted once. A null doc_id is scored, but teaches
    nothing. An empty table gives no rows."""
    rows = written(document_statistics(docs))
    known = (labelled.where("doc_id is not null and label is not null")
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("label").cast("double").alias("label")))
    train = written(rows.join(known, "doc_id").select("stats", "label"))
    width = len(STATISTICS)

    def moments(b):
        x = _matrix(b.column(0), width)
        return np.r_[x.sum(0), (x * x).sum(0), len(x), b.column(1).to_numpy(zero_copy_only=False).sum()]

    m = _summed(train, moments, 2 * width + 2)
    n, positive = m[-2], m[-1]
    if n == 0 or positive in (0, n):
        rate = 0.5 if n == 0 else (positive + 0.5) / (n + 1)
        return rows.select("doc_id", F.lit(float(rate)).alias("score"))
    mean = m[:width] / n
    features = Features(mean, np.sqrt(np.maximum(m[width:2 * width] / n - mean * mean, 0)))
    k = FEATURES + 1

    def normal(b):
        x = features(_matrix(b.column(0), width))
        y = b.column(1).to_numpy(zero_copy_only=False)
        return np.r_[(x.T @ x).ravel(), x.T @ y]

    sums = _summed(train, normal, k * k + k)
    penalty = RIDGE * np.eye(k)
    penalty[-1, -1] = 1e-6
    beta = np.linalg.solve(sums[:k * k].reshape(k, k) + penalty, sums[k * k:])

    def raw(stats: np.ndarray) -> np.ndarray:
        return np.clip(features(stats) @ beta, -0.5, 1.5)

    def bins(b):
        s = raw(_matrix(b.column(0), width))
        at = np.minimum(((s + 0.5) / 2 * BINS).astype(int), BINS - 1)
        return np.r_[np.bincount(at, s, BINS), np.bincount(at, b.column(1).to_numpy(zero_copy_only=False), BINS),
                     np.bincount(at, minlength=BINS)]

    total, label, weight = np.split(_summed(train, bins, 3 * BINS), 3)
    held = weight > 0
    knots = pool_adjacent(total[held] / weight[held], label[held] / weight[held], weight[held])

    def score(batches):
        for b in batches:
            s = raw(_matrix(b.column(1), width))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.clip(np.interp(s, *knots), 0, 1))],
                                             names=["doc_id", "score"])

    return rows.mapInArrow(score, "doc_id long, score double")
