"""Whitening of embeddings by their leading covariance components, found by contour integration (FEAST).

Spark gathers count, sums and centred products of all vectors; what reaches the driver is one d x d matrix.  There, inertia counts of
shifted covariances (how many eigenvalues lie above a shift) cut the upper end of the spectrum into intervals with borders in gaps.  For each
interval a quadrature of solves with complex shifts round it projects a subspace onto its eigenvectors, Rayleigh-Ritz extracts
them, and the inertia counts say whether any is missed.  Spark then projects every vector and measures the covariance of the result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import column_of

SCALE, SHIFT = 1024.0, 100_000
NODES = 16                  # quadrature points on the upper half of a contour
PER_INTERVAL = 4            # eigenvalues an interval holds, unless they cannot be told apart
ROUNDS = 60                 # subspace rounds before a larger subspace is taken
BLOCK_ROWS = 8192           # vectors turned into a matrix at once
_LARGEST = 2.0 ** 40        # whole numbers beyond it are not used: n * x must stay exact


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x`` (array of long, ``floor(1024 c) + 100000``) of rows whose vector is not null, not empty and holds no null or non-finite entry.

    Vectors with an entry of 2^30 or more in size, whose whole numbers would not be exact, are left out as well.
    """
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(_LARGEST / SCALE)))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("bigint") + F.lit(SHIFT)).alias("x"))


def common_length(rows: DataFrame) -> tuple[int, int]:
    """The vector length most rows have (the greater of equals), and the number of those rows; (0, 0) for an empty table."""
    best = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return (best["d"], best["n"]) if best else (0, 0)


def _blocks(batches, dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(i, BLOCK_ROWS)
            yield column_of(part, "vec_id"), column_of(part, "x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _summed(rows: DataFrame, dim: int, width: int, per_block) -> np.ndarray:
    """The sum over all vectors of ``per_block(matrix)``, a vector of ``width`` doubles; tasks add up theirs first."""
    def add(batches):
        total, seen = np.zeros(width), False
        for _, x in _blocks(batches, dim):
            total, seen = total + per_block(x), True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(total)], ["at", "part"])

    out = np.zeros(width)
    for at, value in rows.mapInArrow(add, "at int, part double").groupBy("at").agg(F.sum("part")).collect():
        out[at] = value
    return out


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of ``(n x - S)^2``, exact; null where it passes the range of a long."""
    apart = [int(m) for m in np.abs(x - np.array([s // n for s in sums])).max(axis=0)]
    if sum((n * (a + 1)) ** 2 for a in apart) < 1 << 63:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    whole = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    return [w if w < 1 << 63 else None for w in whole]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - S / n``: the whole part of the mean is taken away exactly, then the rest."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole) - np.array([(s % n) / n for s in sums])


# ---------------------------------------------------------------- the spectrum, on the driver
def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed ``shift``: the positive pivots of a symmetric elimination of ``matrix - shift`` (Sylvester's law of inertia).

    Where a pivot is too small to go on safely, the shift is moved by a few units in the last place of the matrix.
    """
    n, size = len(matrix), np.abs(matrix).max(initial=0.0)
    for attempt in range(20):
        work = matrix - (shift + attempt * 4e-15 * size) * np.eye(n)
        count, safe = 0, True
        for k in range(n):
            pivot = work[k, k]
            if abs(pivot) < 1e-13 * size and k < n - 1:
                safe = False
                break
            count += pivot > 0
            column = work[k + 1:, k] / pivot if pivot else work[k + 1:, k]
            work[k + 1:, k + 1:] -= np.outer(column, work[k, k + 1:])
        if safe:
            return int(count)
    raise ArithmeticError("no safe elimination near the shift")


def cut_spectrum(matrix: np.ndarray, wanted: int, floor: float) -> list[tuple[float, float, int]]:
    """Intervals ``(low, high, eigenvalues)`` from the top down that hold the ``wanted`` largest eigenvalues, all above ``floor``.

    Every eigenvalue needed is bracketed by bisection on inertia counts; borders lie in the middle of gaps.  Eigenvalues too near each
    other for a border stay in one interval, which may thus hold more than wanted.
    """
    n = len(matrix)
    top = float(np.abs(matrix).sum(axis=1).max(initial=0.0)) * (1 + 1e-12)        # no eigenvalue exceeds the largest row sum
    close = 1e-9 * top
    if not top or floor >= top:
        return []
    usable_count = above(matrix, floor)

    def value(k: int) -> float:
        """The k-th largest eigenvalue, from 1, to a thousandth of the distance that counts as a gap."""
        low, high = floor, top
        while high - low > close / 1000:
            middle = (low + high) / 2
            low, high = (middle, high) if above(matrix, middle) >= k else (low, middle)
        return (low + high) / 2

    out, done = [], 0
    previous = value(1) if usable_count else floor
    high = previous * 1.25
    for k in range(1, usable_count + 1):
        last = k == usable_count
        following = floor if last else value(k + 1)
        if last or previous - following > close and (k - done >= PER_INTERVAL or k >= wanted):
            low = max(floor, previous / 2) if last else (previous + following) / 2
            out.append((low, high, k - done))
            high, done = low, k
            if k >= wanted:
                break
        previous = following
    return out


def eigenpairs_between(matrix: np.ndarray, low: float, high: float, expected: int) -> tuple[np.ndarray, np.ndarray]:
    """All eigenpairs in (low, high), largest first, by subspace rounds of a contour projector; ArithmeticError if not as many as expected.

    The projector is the integral of the resolvent along a circle over the interval, by Gauss-Legendre points on its upper half (the
    lower half is its conjugate).  Each round applies it to the subspace and extracts Ritz pairs; it ends once the residuals are at rounding.
    """
    n, scale = len(matrix), np.abs(matrix).max(initial=0.0) * len(matrix)
    points, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi * (points + 1) / 2)
    centre, radius = (low + high) / 2, (high - low) / 2
    resolvents = [np.linalg.inv((centre + radius * t) * np.eye(n) - matrix) for t in turn]
    draw = np.random.default_rng(20)
    width = min(n, expected + max(4, expected // 2))
    while True:
        basis = draw.standard_normal((n, width))
        for _ in range(ROUNDS):
            projected = sum((w * radius / 2 * (t * (r @ basis)).real for w, t, r in zip(weights, turn, resolvents)), np.zeros_like(basis))
            left, strength, _ = np.linalg.svd(projected, full_matrices=False)
            q = left[:, strength > 1e-14 * strength[0]]
            small = q.T @ matrix @ q
            values, turned = np.linalg.eigh((small + small.T) / 2)
            basis = q @ turned
            inside = (values > low) & (values < high)
            found, pairs = values[inside], basis[:, inside]
            residual = np.abs(matrix @ pairs - pairs * found).max(initial=0.0)
            if len(found) == expected and residual <= 4e-16 * scale:
                break
        if len(found) == expected and residual <= 1e-12 * scale:
            return found[::-1], pairs[:, ::-1]
        if width == n:
            raise ArithmeticError(f"{len(found)} eigenvalues found where inertia counts {expected}")
        width = min(n, 2 * width)


def leading_components(matrix: np.ndarray, wanted: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``wanted`` largest eigenvalues and their unit eigenvectors (as columns); eigenvalues that are zero but for rounding have none."""
    if not len(matrix):
        return np.zeros(0), np.zeros((0, 0))
    floor = float(np.trace(matrix)) * 1e-13 * len(matrix)
    pairs = [eigenpairs_between(matrix, *interval) for interval in cut_spectrum(matrix, wanted, floor)]
    if not pairs:
        return np.zeros(0), np.zeros((len(matrix), 0))
    return np.concatenate([p[0] for p in pairs])[:wanted], np.concatenate([p[1] for p in pairs], axis=1)[:, :wanted]


# ---------------------------------------------------------------- the operator
def whiten(vectors: DataFrame, components: int = 8, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: each usable vector's leading whitened components.

    All usable vectors are the fit list (see ``usable``); repeated rows and rows without an id count and are returned each.  Vectors meet only those of
    one length, the one most rows have; others are left out.  Components with no variance are not returned: none for an empty table, a
    single vector or equal vectors.  ``deviation`` is null where it passes the range of a long.
    """
    spark = vectors.sparkSession
    every = usable(vectors, id_col, vector_col)
    dim, n = common_length(every)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not n:
        return spark.createDataFrame([], schema)
    rows = every.filter(F.size("x") == dim)
    sums = _sums(rows, dim, n)
    upper = np.triu_indices(dim)

    def products(x):
        y = _centred(x, n, sums)
        return (y.T @ y)[upper]

    covariance = np.zeros((dim, dim))
    covariance[upper] = _summed(rows, dim, len(upper[0]), products) / n
    covariance = covariance + np.triu(covariance, 1).T
    values, directions = leading_components(covariance, components)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    explained = (values / np.trace(covariance)).tolist()
    turn = directions / np.sqrt(values)

    def measured(x):
        w = _centred(x, n, sums) @ turn
        return np.concatenate(((w.T @ w).ravel(), w.sum(axis=0)))

    total = _summed(rows, dim, k * k + k, measured) / n
    mean = total[k * k:]
    error = float(np.abs(total[:k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())

    def project(batches):
        for ids, x in _blocks(batches, dim):
            m = len(x)
            which = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(which)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                pa.array(_deviation(x, n, sums), pa.int64()).take(pa.array(which)), pa.array((_centred(x, n, sums) @ turn).ravel()),
                pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)


def _sums(rows: DataFrame, dim: int, n: int) -> list[int]:
    """Exact sum of each dimension; tasks add whole numbers in two halves, so that no partial sum leaves the range of a long."""
    def add(batches):
        low, high, seen = [0] * dim, [0] * dim, False
        for _, x in _blocks(batches, dim):
            seen = True
            low = [a + int(b) for a, b in zip(low, (x & 0xFFFFF).sum(axis=0))]
            high = [a + int(b) for a, b in zip(high, (x >> 20).sum(axis=0))]
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["at", "low", "high"])

    out = [0] * dim
    parts = rows.mapInArrow(add, "at int, low bigint, high bigint").groupBy("at")
    for at, low, high in parts.agg(F.sum(F.col("low").cast("decimal(38,0)")), F.sum(F.col("high").cast("decimal(38,0)"))).collect():
        out[at] = int(low) + (int(high) << 20)
    return out
