"""Operator 11: whitening by LOBPCG over distributed covariance products.

An entry c becomes the integer x = floor(64 * c) + 1000000. Sums of x are exact, rows are centred as (n * x - S) / n from exact
integers before anything is multiplied, and the covariance V itself is never formed: a step only needs V times a block of
directions, which is one job that sums ``rows' * (rows * block)`` over all rows. A step (LOBPCG, Knyazev 2001) takes the Ritz
vectors of the span of the iterate, its residuals and the previous directions. It ends when the residuals, computed afresh from
the rows, are small: a residual bounds the distance of its value to an eigenvalue. The driver holds blocks of ``dimensions x 3 *
(components + GUARD)`` numbers at most, whatever the number of rows.

Defined results: vectors that are null or empty or hold null or non-finite entries are dropped, as are vectors of another length
than the commonest (the longer of equally common ones). Rows that repeat count as often as they are there; null ids stay. Where
V's rank is below the number of components, only the components with variance are returned; an empty table gives no rows. Entries
beyond 2**40 raise. Columns that the operator doesn't need are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

SCALE, SHIFT = 64, 1_000_000
#: Directions carried beside the wanted ones, so that the last of these converge too; steps at most.
GUARD, STEPS = 8, 500
#: Residuals, as a share of the largest eigenvalue, that end the iteration; what they must be below at the least; variances that count as none.
FINE, CERTIFIED, NONE = 1e-14, 1e-9, 1e-12
#: Rows taken from a batch at a time.
ROWS = 4096


def fixed_rows(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, x) of the usable rows, x an array of longs of the commonest length."""
    shared.text_batches(vectors.sparkSession)
    v = F.col("v")
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[embedding].cast("array<double>").alias("v")).where(v.isNotNull() & (F.size(v) > 0) & ~odd)
    common = usable.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    usable = usable.where(F.size(v) == (common["d"] if common else 0))

    def run(batches):
        for b in batches:
            flat = np.floor(SCALE * b.column("v").flatten().to_numpy()) + SHIFT
            if len(flat) and np.abs(flat).max() > 2.0**40:
                raise OverflowError("an entry is beyond 2**40 after scaling")
            ends = np.concatenate([[0], np.cumsum(b.column("v").value_lengths().to_numpy())]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int64)))], names=["vec_id", "x"])

    return shared.written(usable.mapInArrow(run, "vec_id long, x array<bigint>"), "whitening-rows")


def _matrices(batches):
    """(ids, x) of a few rows at a time."""
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            part = b.slice(k, ROWS)
            yield part.column("vec_id"), part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)


def _deviations(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit where that fits, else Python integers."""
    most = max(n * int(np.abs(x).max(initial=0)), max(map(abs, s)))
    return n * x - np.array(s, np.int64) if most < 2**62 else n * x.astype(object) - np.array(s, object)


def _summed(rows: DataFrame, shape: tuple[int, int], of) -> np.ndarray:
    """The sum of of(x) over batches of rows, a matrix: summed by task, then by cell, so that only the matrix reaches the driver."""

    def run(batches):
        total = np.zeros(shape)
        for _, x in _matrices(batches):
            total += of(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "value"])

    out = np.zeros(shape[0] * shape[1])
    for r in rows.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r["cell"]] = r["value"]
    return out.reshape(shape)


def _basis(block: np.ndarray, known: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what block adds to the orthonormal columns of known."""
    for _ in range(2):
        block = block - known @ (known.T @ block)
        length = np.linalg.norm(block, axis=0)
        block = block[:, length > 0] / length[length > 0]
        if not block.shape[1]:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10 * s[0]]
    block = block - known @ (known.T @ block)
    return np.linalg.qr(block)[0][:, : known.shape[0] - known.shape[1]]


def lobpcg(product, d: int, k: int, steps: int = STEPS, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, their unit vectors (columns) and residual norms, of the symmetric d x d matrix that product multiplies blocks by."""

    def ritz(basis, image, m):
        e, q = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        return e[::-1][:m], q[:, ::-1][:, :m]

    m = min(k + GUARD, d)
    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, m)))[0]
    ax = product(x)
    e, q = ritz(x, ax, m)
    x, ax, p, best, stale = x @ q, ax @ q, np.zeros((d, 0)), np.inf, 0
    for _ in range(steps):
        residual = ax - x * e
        now = np.linalg.norm(residual[:, :k], axis=0).max() / max(e[0], np.finfo(float).tiny)
        best, stale = (now, 0) if now < best / 2 else (best, stale + 1)
        if now <= FINE or m == d or now <= CERTIFIED and stale >= 3:
            break
        new = _basis(np.hstack([residual, p]), x)
        if not new.shape[1]:
            break
        basis, image = np.hstack([x, new]), np.hstack([ax, product(new)])
        e, q = ritz(basis, image, m)
        p, x, ax = new @ q[m:], basis @ q, image @ q
    x = np.linalg.qr(x)[0]
    ax = product(x)  # afresh: what certifies the result doesn't hold the errors of the steps
    e, q = ritz(x, ax, m)
    x, ax = x @ q, ax @ q
    residual = np.linalg.norm(ax - x * e, axis=0)
    if e[0] > 0 and residual[:k].max() > CERTIFIED * e[0]:
        raise ArithmeticError(f"residuals of {residual[:k].max() / e[0]:.2g} of the largest eigenvalue after {steps} steps")
    turn = np.sign(x[np.abs(x).argmax(axis=0), np.arange(m)])
    return e[:k], (x * turn)[:, :k], residual[:k]


def whiten(vectors: DataFrame, components: int = 32, vec_id: str = "vec_id", embedding: str = "embedding", steps: int = STEPS) -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error) of each usable row.

    deviation: decimal, the exact sum over dimensions of (n * x - S)**2; whitened and explained: arrays over components, by falling
    eigenvalue; identity_error: of the whitened rows' covariance, measured over all of them.
    """
    rows = fixed_rows(vectors, vec_id, embedding)

    def sums(batches):
        for _, x in _matrices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1] + 1)), pa.array(np.append(x.sum(axis=0), len(x)))], names=["cell", "value"])

    found = sorted(map(tuple, rows.mapInArrow(sums, "cell long, value long").groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("s")).collect()))
    s = [int(value) for _, value in found]
    n, s = (s[-1], s[:-1]) if s else (0, [])
    d = len(s)
    centred = lambda x: (_deviations(x, n, s) / n).astype(np.float64)
    e, axes, trace, error = np.zeros(0), np.zeros((d, 0)), 0.0, 0.0
    if n:
        trace = float(_summed(rows, (1, 1), lambda x: (centred(x) ** 2).sum().reshape(1, 1))[0, 0]) / n
    if trace > 0:
        product = lambda w: _summed(rows, (d, w.shape[1]), lambda x: (c := centred(x)).T @ (c @ w)) / n
        e, axes, _ = lobpcg(product, d, min(components, d), steps)
        real = e > NONE * d * e[0]
        e, axes = e[real], axes[:, real]
        to_white = axes / np.sqrt(e)
        k = len(e)
        mean = _summed(rows, (1, k), lambda x: (centred(x) @ to_white).sum(axis=0).reshape(1, k)) / n
        white = _summed(rows, (k, k), lambda x: (z := centred(x) @ to_white - mean).T @ z) / n
        error = float(np.abs(white - np.eye(k)).max())
    else:
        to_white = axes

    def out(batches):
        for ids, x in _matrices(batches):
            dev = _deviations(x, n, s)
            fits = dev.dtype != object and d * int(np.abs(dev).max(initial=0)) ** 2 < 2**62
            total = ((dev if fits else dev.astype(object)) ** 2).sum(axis=1)
            z = (dev / n).astype(np.float64) @ to_white
            ends = np.arange(0, z.size + 1, z.shape[1], dtype=np.int32) if z.shape[1] else np.zeros(len(z) + 1, np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.array([int(t) for t in total], pa.decimal128(38, 0)), pa.ListArray.from_arrays(pa.array(ends), pa.array(z.ravel()))], names=["vec_id", "deviation", "whitened"])

    white = rows.mapInArrow(out, "vec_id long, deviation decimal(38,0), whitened array<double>")
    explained = F.array(*[F.lit(float(x / trace)) for x in e]).cast("array<double>")
    return white.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
