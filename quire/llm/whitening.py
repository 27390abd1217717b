"""Whitening of embeddings by shifted CholeskyQR (operator 13).

The centred rows A are factored as Q R without ever forming the ill-conditioned covariance: a pass
over the rows sums the Gram matrix of Q = A R^-1 (rows are solved against the triangle R in each
task), its Cholesky factor is multiplied onto R, and the next pass starts from the new R.  The first
factor is of a shifted Gram matrix, so it exists for any A.  The singular values and right singular
vectors of R are those of A; they give the whitening components.

Only sums of the size of the Gram matrix (dimensions squared) reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.staging import settle

SCALE = 256
#: Whole numbers of this size and more are set to it, so that they stay exact in a double and a long.
LARGEST = 1 << 52
WHITENED = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)
BLOCK = 4096  # rows solved at a time
_EPS = np.finfo(float).eps


def grid(vectors: DataFrame) -> DataFrame:
    """``vec_id, x``: each vector's components times 256, rounded down to whole numbers.

    Rows whose vector is null or holds a null or non-finite component are left out.  Numbers
    beyond 2^52 are set to it.  Repeated rows stay.
    """
    each = F.col("embedding")
    finite = F.forall(each, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))

    def whole(c):
        return F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST))))

    return vectors.where(each.isNotNull() & finite).select("vec_id", F.transform(each, whole).alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dims)


def centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """``x - sums / n`` of whole numbers; the difference is taken before any rounding where 64 bits hold it."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if most < 1 << 61:
        return (x * np.int64(n) - np.array(sums, np.int64)) / n
    return ((x.astype(object) * n - np.array(sums, object)) / n).astype(float)


def deviations(x: np.ndarray, sums: list[int], n: int) -> list[int | None]:
    """Exact sum of squares of ``n * x - sums``; None where it does not fit a long."""
    dims = x.shape[1]
    most = max(int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0), 1)
    if most * most * max(dims, 1) < 1 << 62:
        away = x * np.int64(n) - np.array(sums, np.int64)
        return (away * away).sum(axis=1).tolist()
    away = x.astype(object) * n - np.array(sums, object)
    found = [sum(int(v) * int(v) for v in row) for row in away]
    return [v if v < 1 << 63 else None for v in found]


def solve_rows(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """``rows @ inverse(upper)`` by substitution, column after column."""
    out = np.empty_like(rows)
    for j in range(upper.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def _sum_over(
    rows: DataFrame, dims: int, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], kind: str = "double"
) -> np.ndarray:
    """Sum over all rows of a small matrix of ``kind`` that ``of`` makes from a block of whole-number rows.

    Each task adds up its own blocks and hands on one matrix, cell by cell; Spark sums the cells.
    """

    dtype = np.int64 if kind == "long" else float

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            for at in range(0, len(x), BLOCK):
                total += of(x[at : at + BLOCK])
        yield pa.record_batch([np.arange(total.size), total.ravel()], names=["cell", "value"])

    cells = rows.select("x").mapInArrow(run, f"cell long, value {kind}")
    out = np.zeros(shape[0] * shape[1], dtype)
    for cell, value in cells.groupBy("cell").agg(F.sum("value")).collect():
        out[cell] = value
    return out.reshape(shape)


def triangle(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper Cholesky factor of ``gram``, shifted by as little as it takes, ``shift`` at least."""
    gram = (gram + gram.T) / 2
    least = _EPS * max(np.trace(gram), np.finfo(float).tiny) * len(gram)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(2 * shift, least)


def orthogonal_factor(fit: DataFrame, dims: int, sums: list[int], n: int, most_passes: int = 6) -> np.ndarray:
    """A matrix R with ``R^T R`` equal to the Gram matrix of the centred rows of ``fit``, to double precision.

    Passes end when Q's Gram matrix is the identity.  Where the rows do not span all dimensions that
    cannot be; the passes end when a further one changes nothing, and the last Gram matrix is
    taken into R as its square root.
    """
    factor = np.eye(dims)
    last = None
    for turn in range(most_passes):
        upper = factor

        def gram_of(x: np.ndarray) -> np.ndarray:
            q = solve_rows(centred(x, sums, n), upper)
            return q.T @ q

        gram = _sum_over(fit, dims, gram_of, (dims, dims))
        if turn == 0:
            # The customary shift for n rows of d columns: 11 (n d + d (d + 1)) u times the largest eigenvalue.
            shift = 11 * (n * dims + dims * (dims + 1)) * _EPS / 2 * max(np.linalg.norm(gram, 2), np.finfo(float).tiny)
            shift = min(shift, 1e-3 * max(np.linalg.norm(gram, 2), np.finfo(float).tiny))
        else:
            shift = 0.0
            apart = np.abs(gram - np.eye(dims)).max()
            if apart < 1e-12 * dims or (last is not None and apart >= last / 2):
                break
            last = apart
        factor = triangle(gram, shift) @ factor
    else:
        gram = np.eye(dims)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    return (vectors * np.sqrt(np.maximum(values, 0))).T @ factor


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    """Each row's place along the first whitening components of all distinct vectors.

    ``vectors`` holds ``vec_id, embedding``; the result one row for each kept row and component:
    ``vec_id, component, n, deviation, whitened, explained, identity_error``.  Components are
    unit eigenvectors of the covariance of the distinct rounded vectors, by falling eigenvalue.

    Rows with a null vector or a null or non-finite component are left out; so are rows of another
    length than most rows have (ties: the longer).  A null id and repeated rows are kept.  Only
    components with a variance clearly above rounding are returned, so vectors that are all equal, or
    none, give no rows; components of equal variance come in an arbitrary but fixed order.  A deviation beyond
    64 bits is null.  Other columns of ``vectors`` are ignored.
    """
    rows = grid(vectors)
    size = F.size("x").alias("dims")
    lengths = rows.groupBy(size).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    dims = lengths[0]["dims"] if lengths else 0
    if dims == 0:
        return vectors.sparkSession.createDataFrame([], WHITENED)
    rows = rows.where(F.size("x") == dims)
    fit = settle(rows.select("x").distinct())

    def digits(x: np.ndarray) -> np.ndarray:
        """Count, and sums in two parts that no number of rows takes out of 64 bits."""
        high = (x + (1 << 25)) >> 26
        return np.concatenate(([len(x)], high.sum(axis=0), (x - (high << 26)).sum(axis=0)))[None, :]

    parts = [int(v) for v in _sum_over(fit, dims, digits, (1, 2 * dims + 1), "long")[0]]
    n, sums = parts[0], [(h << 26) + low for h, low in zip(parts[1 : dims + 1], parts[dims + 1 :])]

    factor = orthogonal_factor(fit, dims, sums, n)
    _, singular, axes = np.linalg.svd(factor)
    eigen = singular**2 / n
    clear = eigen > eigen[0] * dims * dims * _EPS * _EPS * 4
    clear &= eigen > 0
    kept = min(components, int(clear.sum()))
    directions = axes[:kept].T / np.sqrt(eigen[:kept])
    explained = eigen[:kept] / eigen.sum()

    def project(x: np.ndarray) -> np.ndarray:
        return centred(x, sums, n) @ directions

    def moments(x: np.ndarray) -> np.ndarray:
        own = project(x)
        return np.vstack([own.T @ own, own.sum(axis=0)])

    if kept == 0:
        return vectors.sparkSession.createDataFrame([], WHITENED)
    total = _sum_over(fit, dims, moments, (kept + 1, kept)) / n
    mean = total[-1]
    error = float(np.abs(total[:-1] - np.outer(mean, mean) - np.eye(kept)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _matrix(part.column(1), dims)
                count = len(x)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(count), kept)))
                away = pa.array(deviations(x, sums, n), pa.int64()).take(pa.array(np.repeat(np.arange(count), kept)))
                yield pa.record_batch(
                    [
                        ids, pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), count)),
                        pa.array(np.full(count * kept, n)), away, pa.array(project(x).ravel()),
                        pa.array(np.tile(explained, count)), pa.array(np.full(count * kept, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, WHITENED)
