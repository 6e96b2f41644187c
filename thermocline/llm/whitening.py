"""Whitening of vectors by shifted CholeskyQR.

The centred rows A are never moved and never leave the tasks. A pass sums the Gram matrix of A over all tasks, its
Cholesky factor R gives nearly orthogonal rows A R^-1 by a triangular solve for each row, and the next pass does the same
to those. The first factor is that of the Gram matrix plus a small shift, which always exists; two more passes bring the
rows to orthogonality at double precision. The product of the factors has the singular values of A and its right
singular vectors, so its decomposition on the driver, as large as a vector is long in each direction, gives components
and their variances without the squared condition number of a covariance matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from thermocline.llm.common import public_id
from thermocline.llm.dense import common_length, matrix, vectors_of
from thermocline.session import durable

#: Passes over the rows that orthogonalise them; the first is shifted.
PASSES = 3
#: Entries beyond this size leave no room for exact sums of whole numbers.
MOST_ENTRY = 2.0 ** 40
_SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def solve_rows(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a R^-1 for an upper triangular R, column by column."""
    out = np.empty_like(a)
    for j in range(a.shape[1]):
        out[:, j] = (a[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def cholesky(gram: np.ndarray, shift: float = 0.0) -> np.ndarray:
    """Upper triangular R with R'R = gram + shift I; a shift that does not suffice grows until it does."""
    size = max(float(np.trace(gram)), np.finfo(float).tiny)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, np.finfo(float).eps * size)


def _summed(rows: DataFrame, entry, length: int, kind: str) -> np.ndarray:
    """Sum over all rows of `entry(block)`, a vector of `length` numbers for a block of rows; blocks are added in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = entry(batch.column(0))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(length, dtype="i4")), pa.array(total)], names=["at", "s"])

    parts = rows.mapInArrow(run, f"at int, s {kind}").groupBy("at").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(length, "i8" if kind == "long" else "f8")
    for r in parts:
        out[r["at"]] = r["s"]
    return out


class Whitening:
    """n and sums of the fit list, components (a column each), their variances and shares, and the identity's error."""

    def __init__(self, n, sums, components, variances, explained, identity_error=0.0):
        self.n, self.sums, self.components, self.variances = n, sums, components, variances
        self.explained, self.identity_error = explained, identity_error

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Exact multiples n (x - mean), as whole numbers."""
        return x * self.n - self.sums

    def project(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n) @ self.components / np.sqrt(self.variances)


def fit(points: DataFrame, length: int, components: int = 16, passes: int = PASSES) -> Whitening:
    """Whitening of the distinct rows of `points` (x, an array of `length` longs).

    The driver gets `length` sums and `length` squared sums of products a pass, whatever the number of rows. Components
    whose variance is zero up to rounding are left out.
    """
    points = durable(points.select("x").distinct())
    found = _summed(points, lambda c: np.r_[matrix(c, length).sum(axis=0), len(c)], length + 1, "long")
    n, sums = int(found[-1]), found[:-1]
    model = Whitening(n, sums, np.zeros((length, 0)), np.zeros(0), np.zeros(0))
    if not n:
        return model
    upper = np.triu_indices(length)
    factors: list[np.ndarray] = []
    for step in range(passes):
        shared = points.sparkSession.sparkContext.broadcast((model, list(factors)))

        def products(column, shared=shared):
            own, before = shared.value
            rows = own.centred(matrix(column, length)) / own.n
            for r in before:
                rows = solve_rows(rows, r)
            return (rows.T @ rows)[upper]

        gram = np.zeros((length, length))
        gram[upper] = _summed(points, products, len(upper[0]), "double")
        gram += np.triu(gram, 1).T
        if not gram.any():
            return model
        norm = np.linalg.norm(gram, 2)
        shift = 11 * (n * length + length * (length + 1)) * np.finfo(float).eps * norm if not step else 0.0
        factors.append(cholesky(gram, min(shift, 0.01 * norm)))
    r = factors[0]
    for later in factors[1:]:
        r = later @ r
    _, values, right = np.linalg.svd(r)
    kept = min(components, int((values > max(n, length) * np.finfo(float).eps * values[0]).sum()))
    variances = values ** 2 / n
    model = Whitening(n, sums, right[:kept].T.copy(), variances[:kept], variances[:kept] / variances.sum())
    shared = points.sparkSession.sparkContext.broadcast(model)

    def moments(column):
        y = shared.value.project(matrix(column, length))
        return np.r_[(y.T @ y).ravel(), y.sum(axis=0)]

    found = _summed(points, moments, kept * kept + kept, "double") / n
    means = found[kept * kept:]
    covariance = found[:kept * kept].reshape(kept, kept) - np.outer(means, means)
    model.identity_error = float(np.abs(covariance - np.eye(kept)).max())
    return model


def whiten(rows: DataFrame, components: int = 16, steps: int = 64, offset: int = 1_000_000) -> DataFrame:
    """Coordinates of every usable vector on the leading whitened components of all distinct ones.

    Entries c become x = floor(steps * c) + offset. Returns a row for each row of `rows` and component: vec_id, component
    (from 1), n (distinct vectors x), deviation (exact sum of (n x - S)^2 over dimensions, S their sums), whitened (the
    centred vector on the component, over its standard deviation), explained (share of the whole variance) and
    identity_error (largest entry of the whitened covariance minus the identity, by a pass over all distinct vectors).

    Rows whose vector is null or empty, or holds a null, NaN, infinite or huge entry (2^40 or more) are dropped, and so are
    those of another length than most have. Repeated rows get equal results and count once in the fit; a null vec_id
    stays null. Components without variance are left out: a table of equal vectors, or an empty one, gives no rows. A
    deviation beyond 64 bits is null. Columns other than vec_id and embedding are ignored.
    """
    used = vectors_of(rows, MOST_ENTRY)
    length = common_length(used)
    used = used.where(F.col("fit") & (F.size("v") == length))
    used = used.select("vec_id", F.transform("v", lambda c: F.floor(c * steps) + F.lit(offset).cast("long")).alias("x"))
    model = fit(used, length, components) if length else Whitening(0, np.zeros(0), np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        k = len(own.variances)
        for batch in batches:
            for start in range(0, batch.num_rows if k else 0, 4096):
                part = batch.slice(start, 4096)
                x = matrix(part.column(1), length)
                whole = own.centred(x)
                rough = (whole.astype(float) ** 2).sum(axis=1)
                exact = (whole * whole).sum(axis=1)
                m = len(x)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), m)),
                     pa.array(np.full(m * k, own.n)), pa.array(np.repeat(exact, k), mask=np.repeat(rough >= 9.2e18, k)),
                     pa.array(own.project(x).ravel()), pa.array(np.tile(own.explained, m)),
                     pa.array(np.full(m * k, own.identity_error))], names=[c.split()[0] for c in _SCHEMA.split(", ")])

    return used.mapInArrow(run, _SCHEMA).withColumn("vec_id", public_id("vec_id"))
