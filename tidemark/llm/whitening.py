"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become integers, so the sums of the distinct vectors (the fit list) are exact. On the centred rows X of the fit
list, the bidiagonalisation alternates u = Xv and v = X'u, each new vector orthogonalised against all earlier ones.
The long vectors u are never stored: each is a known combination of X's columns (``u = Xw``), so a pass over the rows
remakes them batch by batch, and one distributed pass per step returns X'u, the products with all earlier u, and u's
length. The singular value decomposition of the small bidiagonal matrix gives components and deviations.

Passes are at most the number of dimensions, at any number of rows. They end earlier only with a proof: the wanted
triplets have converged, and what the Krylov space leaves of the trace is less than the smallest wanted eigenvalue, so
no component can have been missed (repeated eigenvalues included).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import summed, written

COMPONENTS, SCALE, SHIFT, SEED = 16, 64, 1_000_000, 12
#: Entries from here on have no exact integer form and count as not finite.
LARGEST = 2.0 ** 52 / SCALE
#: A direction whose length is below this share of the root of the total holds rounding errors only.
RANK = 1e-12
#: Sums are kept as two limbs of this many low bits, so that no task's sum overflows.
LOW_BITS = 26
RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


def integers(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the usable rows: vector not null and without null or non-finite entries."""
    v = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    usable = F.forall("v", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))          # NaN is above any number
    return (v.where(F.col("v").isNotNull() & usable)
            .select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Centre:
    """Exact means: integer parts and remainders of S / n."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)            # below n

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n*x - S)^2, exact; None where no long holds it."""
        off = x - self.whole
        near = np.abs(off).max(initial=0) < 2.0 ** 61 / self.n
        scaled = (off if near else off.astype(object)) * self.n - self.rest
        about = (scaled.astype(float) ** 2).sum(1)
        if near and about.max(initial=0) < 2.0 ** 62:
            return (scaled * scaled).sum(1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in scaled]
        return [e if e < 1 << 63 else None for e in exact]


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows of the fit list and its exact sum per dimension."""
    def cells(b):
        x = _matrix(b.column(0), d)
        return np.r_[len(x), (x >> LOW_BITS).sum(0), (x & ((1 << LOW_BITS) - 1)).sum(0)]

    out = summed(fit, cells, 2 * d + 1, np.int64)
    return int(out[0]), [(int(h) << LOW_BITS) + int(low) for h, low in zip(out[1:d + 1], out[d + 1:])]


def _orthogonal(r: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        r = r - basis @ (basis.T @ r)
    return r


def bidiagonalise(step, d: int, wanted: int, total: float) -> tuple[np.ndarray, np.ndarray]:
    """Singular values (falling) and right singular vectors (columns) of a matrix with ``d`` columns and the sum of
    squares ``total``, at least the first ``wanted``.

    ``step(v, beta, w)`` returns (U'y, y'y, X'y) for U = Xw and y = Xv - beta * (last column of U)."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    tiny = RANK * np.sqrt(total)
    vs = ws = qs = np.zeros((d, 0))                  # v_j; w_j with u_j = X w_j; X'u_j
    alphas, betas, beta = [], [], 0.0
    r = rng.standard_normal(d)
    while True:
        v = r / np.linalg.norm(r)
        c, square, q = step(v, beta, ws)
        w = v - ws @ c - (beta * ws[:, -1] if beta else 0.0)
        q = q - qs @ c
        alpha = np.sqrt(max(square - c @ c, 0.0))
        if alpha <= tiny:
            alpha, w, q = 0.0, np.zeros(d), np.zeros(d)
        else:
            w, q = w / alpha, q / alpha
        vs, ws, qs = np.c_[vs, v], np.c_[ws, w], np.c_[qs, q]
        alphas.append(alpha)
        betas.append(beta)
        left, s, right = np.linalg.svd(np.diag(alphas) + np.diag(betas[1:], 1))
        k = len(s)
        if k == d:
            break
        r = _orthogonal(q - alpha * v, vs)
        beta = np.linalg.norm(r)
        if beta <= tiny:                             # the space is invariant: go on in a fresh direction
            beta, r = 0.0, _orthogonal(rng.standard_normal(d), vs)
        rest = total - float(s @ s)
        if beta == 0.0 and rest <= 1e-13 * total:
            break
        if (k >= wanted and (beta * np.abs(left[-1, :wanted]) <= 1e-15 * np.sqrt(total)).all()
                and rest < (1 - 1e-9) * s[wanted - 1] ** 2):
            break
    return s, vs @ right.T


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per usable row of ``embeddings`` (vec_id, embedding; other columns are not read) and component (up to
    ``components``): n, deviation, whitened value, explained share of the trace, and the identity error.

    Rows whose vector is null or holds null or non-finite entries have no result. Repeated vectors count once in the
    fit list and each keep their rows; a null vec_id stays null. Where vectors differ in length, those of the most
    frequent length (ties: the longest) are used and the others treated like unusable ones. Components with
    eigenvalue zero don't exist: a table of one distinct vector, or an empty one, gives no rows. Between equal
    eigenvalues the order and basis are arbitrary but the same for all rows. deviation is null where it exceeds a long."""
    rows = integers(embeddings)
    spark = embeddings.sparkSession
    size = (rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("rows"))
            .agg(F.max(F.struct("rows", "d")).alias("best")).first()["best"])
    d = size["d"] if size else 0
    if not d:
        return spark.createDataFrame([], RESULT)
    rows = rows.where(F.size("x") == d)
    fit = written(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).select("x"))
    centre = Centre(*exact_sums(fit, d))
    n = centre.n
    total = float(summed(fit, lambda b: (centre(_matrix(b.column(0), d)) ** 2).sum(), 1)[0])
    if total == 0.0:
        return spark.createDataFrame([], RESULT)

    def step(v, beta, w):
        k = w.shape[1]

        def cells(b):
            x = centre(_matrix(b.column(0), d))
            u = x @ w
            y = x @ v - (beta * u[:, -1] if beta else 0.0)
            return np.r_[u.T @ y, y @ y, x.T @ y]

        out = summed(fit, cells, k + 1 + d)
        return out[:k], out[k], out[k + 1:]

    wanted = min(components, d)
    s, vectors = bidiagonalise(step, d, wanted, total)
    held = int((s[:wanted] > RANK * np.sqrt(total)).sum())
    s, vectors = s[:held], vectors[:, :held]
    project = vectors / (s / np.sqrt(n))
    explained = s ** 2 / total

    def moments(b):
        w = centre(_matrix(b.column(0), d)) @ project
        return np.r_[w.sum(0), (w.T @ w).ravel()]

    sums = summed(fit, moments, held + held * held) / n
    spread = sums[held:].reshape(held, held) - np.outer(sums[:held], sums[:held])
    error = float(np.abs(spread - np.eye(held)).max())

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), d)
            m = len(x) * held
            own = np.repeat(np.arange(len(x)), held)
            part = np.tile(np.arange(held), len(x))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(own)), pa.array((part + 1).astype(np.int32)), pa.array(np.full(m, n)),
                 pa.array(centre.deviations(x), pa.int64()).take(pa.array(own)),
                 pa.array((centre(x) @ project).ravel()), pa.array(explained[part]), pa.array(np.full(m, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, RESULT)
