"""Operator 13, embedding whitening: principal components by matrix-free block subspace iteration.

No covariance matrix is formed by a Spark job: each pass over the rows computes Xᵀ(XQ) for a narrow block Q, on rows
centred before they are multiplied. The driver orthonormalises blocks (QR), solves the Rayleigh-Ritz problem in the
block, and measures the residuals ‖VZ - Zθ‖ of all k components; it ends when each is certified. Otherwise the next
block holds the 2k leading Ritz vectors, the k residuals and the k last steps, so that flat spectra converge too. The
block has 4k columns; where the vectors have no more entries than that, it spans the whole space and the first pass is
certified.

What reaches the driver is one d x 4k block of sums a pass, whatever the number of rows or tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm._tables import stored

#: Entries are counted in steps of 1 / SCALE, above OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: |SCALE x entry| below this fits a long; greater entries count as not finite.
FITS = float(1 << 62)
#: A component whose share of the first eigenvalue is not above this is rounding error, not variance.
RANK = 1e-11
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Basis:
    """The fitted transform: n distinct vectors, their sums S, and unit eigenvectors (columns) with their eigenvalues."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    residual: float

    def split(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(floor(S/n), S mod n, (S mod n)/n): x - S/n is (x - floor) - rest, exact until its last rounding."""
        low = [s // self.n for s in self.sums]
        rest = [s % self.n for s in self.sums]
        return np.array(low, np.int64), np.array(rest, np.int64), np.array([float(Fraction(r, self.n)) for r in rest])


def counted(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x): the rows whose vectors have only finite entries, as longs."""
    fine = F.forall("embedding", lambda c: F.coalesce((~F.isnan(c.cast("double"))) & (F.abs(c.cast("double") * SCALE) < FITS), F.lit(False)))
    kept = embeddings.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & fine & (F.size("embedding") > 0))
    return kept.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _summed(fit: DataFrame, partial, size: int) -> np.ndarray:
    """The sum over all rows of ``partial`` (longs of a batch -> ``size`` doubles): by task, then by place in the block."""
    spark_type = "y array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += partial(batch.column(0)).ravel()
        yield pa.record_batch([pa.array([total], pa.list_(pa.float64()))], names=["y"])

    each = fit.select("x").mapInArrow(run, spark_type).select(F.posexplode("y").alias("at", "v"))
    out = np.zeros(size)
    for r in each.groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def _orthonormal(*blocks: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the blocks' columns, in their order; columns that add nothing are left out."""
    out = np.zeros((blocks[0].shape[0], 0))
    for block in blocks:
        if block.shape[1]:
            size = np.linalg.norm(block, axis=0)
            block = block[:, size > 0] / size[size > 0]
            for _ in range(2):
                block = block - out @ (out.T @ block)
            q, r = np.linalg.qr(block)
            out = np.hstack([out, q[:, np.abs(np.diag(r)) > 1e-8]])
    return np.linalg.qr(out)[0]


def fit_basis(fit: DataFrame, width: int, k: int = 16, tolerance: float = 1e-12, most: int = 500) -> Basis:
    """The k leading components of the covariance of ``fit`` (x: array of ``width`` longs, each distinct vector once).

    A component is certified when its residual is at most ``tolerance`` x the first eigenvalue. Raises after ``most`` passes.
    """
    spread = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(19,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    rows = {r["i"]: (int(r["s"]), r["n"]) for r in spread.collect()}
    n = rows[0][1]
    basis = Basis(n, [rows[i][0] for i in range(width)], np.zeros((width, 0)), np.zeros(0), 0.0, 0, 0.0)
    low, _, rest = basis.split()
    centred = lambda column: (_matrix(column, width) - low).astype(float) - rest
    q = np.linalg.qr(np.random.default_rng(13).standard_normal((width, min(width, 4 * k))))[0]
    step = np.zeros((width, 0))
    while True:
        block = q

        def product(column, block=block):
            c = centred(column)
            return np.append((c.T @ (c @ block)).ravel(), (c * c).sum())

        got = _summed(fit, product, width * block.shape[1] + 1) / n
        image, basis.trace = got[:-1].reshape(width, -1), got[-1]
        basis.passes += 1
        inner = block.T @ image
        theta, turn = np.linalg.eigh((inner + inner.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz, applied = block @ turn, image @ turn
        gap = applied[:, :k] - ritz[:, :k] * theta[:k]
        basis.residual = float(np.linalg.norm(gap, axis=0).max())
        if basis.residual <= tolerance * max(theta[0], 0.0) or theta[0] <= 0:
            real = theta[:k] > RANK * max(theta[0], 0.0)
            basis.vectors, basis.values = ritz[:, :k][:, real], theta[:k][real]
            return basis
        if basis.passes >= most:
            raise RuntimeError(f"not certified after {most} passes: the largest residual is {basis.residual:g}")
        before = step
        step = ritz[:, :k]
        moved = step - before @ (before.T @ step) if before.shape[1] else step[:, :0]
        q = _orthonormal(ritz[:, : 2 * k], gap, moved)


def identity_error(fit: DataFrame, width: int, basis: Basis) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(basis.values)
    low, _, rest = basis.split()
    scaled = basis.vectors / np.sqrt(basis.values)

    def products(column):
        c = (_matrix(column, width) - low).astype(float) - rest
        w = c @ scaled
        return np.append((w.T @ w).ravel(), w.sum(0))

    got = _summed(fit, products, k * k + k) / basis.n
    mean = got[k * k :]
    return float(np.abs(got[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(embeddings: DataFrame, k: int = 16) -> DataFrame:
    """One row for each vector and component: its whitened coordinate, with the component's share of the variance.

    embeddings: vec_id, embedding and any other columns, which are ignored whatever their names. Rows whose vector is
    null or empty, or holds a null, a NaN, an infinity or an entry too great for a long, are left out. Vectors of another
    length than the most frequent one among the distinct vectors (ties: the longer) have no coordinates here and are left
    out. Equal vectors count once in the fit, and each has its own rows in the result; so have repeated and null ids.
    Components without variance (all vectors equal, or fewer dimensions than k) have no rows; an empty table, a single
    vector and equal vectors give none at all. Equal eigenvalues span a space of which any basis may come. deviation is
    null where the exact sum does not fit a long.
    """
    spark = embeddings.sparkSession
    remaining = counted(embeddings)
    fit = stored(remaining.select("x").distinct(), "distinct-vectors")
    longest = fit.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), F.col("d").desc()).first()
    if longest is None:
        return spark.createDataFrame([], OUT)
    width = longest["d"]
    fit = fit.where(F.size("x") == width)
    basis = fit_basis(fit, width, k)
    if not len(basis.values):
        return spark.createDataFrame([], OUT)
    error = identity_error(fit, width, basis)
    low, rest, fraction = basis.split()
    scaled, n, found = basis.vectors / np.sqrt(basis.values), basis.n, len(basis.values)
    explained = basis.values / basis.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            away = _matrix(batch.column(1), width) - low
            white = (away.astype(float) - fraction) @ scaled
            terms = away * np.int64(n) - rest
            deviation = (terms * terms).sum(1)  # exact modulo 2**64
            size = ((away.astype(float) * n - rest) ** 2).sum(1)
            exact: list[int | None] = deviation.tolist()
            for i in np.nonzero(size > 4e18)[0]:
                whole = sum((int(a) * n - int(r)) ** 2 for a, r in zip(away[i], rest))
                exact[i] = whole if whole < 1 << 63 else None
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), found)))
            yield pa.record_batch(
                [
                    ids, pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), batch.num_rows)), pa.array(np.full(batch.num_rows * found, n)),
                    pa.array(exact, pa.int64()).take(pa.array(np.repeat(np.arange(batch.num_rows), found))), pa.array(white.ravel()),
                    pa.array(np.tile(explained, batch.num_rows)), pa.array(np.full(batch.num_rows * found, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return remaining.where(F.size("x") == width).select(F.col("vec_id").cast("long"), "x").mapInArrow(project, OUT)
