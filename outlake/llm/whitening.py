"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

1. Components become integers x = floor(64 c) + 1000000; their sums S and the count n are exact.
2. The scatter of (n x - S) / n is summed in every task and added up over tasks, a row of it per key.
3. With P V P' = L L' (pivoting stops at the numerical rank), rotations from the right make the columns of L orthogonal:
   their squared norms are the eigenvalues of V, the normalised columns its unit eigenvectors.  This keeps the relative
   precision of small eigenvalues, which a decomposition of V itself loses.
4. Every vector is projected; the covariance of what comes out is measured, centred again, against the identity.

Only sums, d x d doubles for vectors of d components, reach the driver, never vectors.

Defined results: vectors that are null, empty or hold null or non-finite components are dropped, as are those of another
length than the commonest one (ties: the longest); components of any size are taken (floors beyond a long are its
limits); a deviation beyond a long is null; components of the numerical null space can't be scaled to variance one and
are left out, so equal vectors, or one vector, give no rows; null ids are carried along; repeated rows and ids count once
for each row; of equal eigenvalues the component that the rotations leave first comes first; the largest entry of a component (the first of equal
ones) is positive; empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from outlake.llm.vectors import array_sums, column_sums, halves, joined, matrix, usable, whole

FACTOR, OFFSET = 64, 1_000_000
COMPONENTS = 32
SWEEPS = 60
_OUT = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def pivoted_cholesky(v):
    """L with v = L L' (rows in v's order, which makes L[pivots] lower trapezoidal), and the pivots."""
    import numpy as np

    d = len(v)
    pivots, factor, left = np.arange(d), np.zeros((d, d)), v.diagonal().astype(float).copy()
    least = d * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    for k in range(d):
        at = k + int(np.argmax(left[pivots[k:]]))
        if left[pivots[at]] <= least:
            return factor[:, :k], pivots
        pivots[[k, at]] = pivots[[at, k]]
        p, rest = pivots[k], pivots[k + 1 :]
        factor[p, k] = np.sqrt(left[p])
        factor[rest, k] = (v[rest, p] - factor[rest, :k] @ factor[p, :k]) / factor[p, k]
        left[rest] -= factor[rest, k] ** 2
    return factor, pivots


def _rounds(n: int):
    """All pairs of n columns in rounds of disjoint pairs (a round-robin tournament)."""
    import numpy as np

    order = list(range(n + n % 2))
    half = len(order) // 2
    for _ in range(len(order) - 1):
        pairs = [(a, b) for a, b in zip(order[:half], order[:half - 1:-1], strict=True) if a < n and b < n]
        if pairs:
            yield np.array(pairs).T
        order = [order[0], order[-1], *order[1:-1]]


def one_sided_jacobi(factor):
    """Eigenvalues of factor factor', falling, and their unit eigenvectors as columns."""
    import numpy as np

    work, eps = factor.copy(), np.finfo(float).eps
    for _ in range(SWEEPS):
        turned = False
        for i, j in _rounds(work.shape[1]):
            a, b = work[:, i], work[:, j]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            turn = np.abs(ab) > eps * np.sqrt(aa * bb)
            if not turn.any():
                continue
            turned = True
            zeta = (bb - aa) / (2 * np.where(turn, ab, 1.0))
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            s = c * t
            work[:, i], work[:, j] = c * a - s * b, s * a + c * b
        if not turned:
            break
    norms = np.sqrt((work * work).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    vectors = work[:, order] / norms[order]
    if vectors.size:
        peak = np.abs(vectors).argmax(axis=0)
        vectors *= np.sign(vectors[peak, np.arange(vectors.shape[1])])
    return norms[order] ** 2, vectors


def centred(x, n: int, sums: list[int]):
    """n x - S, exactly, and divided by n."""
    import numpy as np

    if x.dtype != object and n * (int(np.abs(x).max()) if x.size else 0) + max(map(abs, sums)) < 2**62:
        off = n * x - np.array(sums, np.int64)
        return off, off / float(n)
    off = n * x.astype(object) - np.array(sums, object)
    return off, (off / n).astype(float)


def deviations(off) -> list[int | None]:
    """Exact sums of squares along the rows; null beyond a long."""
    import numpy as np

    if off.dtype == object or off.shape[1] * (int(np.abs(off).max()) if off.size else 0) ** 2 >= 2**63:
        off = off.astype(object)
    return [v if v < 2**63 else None for v in (int(s) for s in (off * off).sum(axis=1))]


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _partial_sums(size: int, of: Callable) -> Callable:
    """A row for each task: exact column sums of the integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * size
        for batch in batches:
            total = [a + b for a, b in zip(total, column_sums(of(matrix(batch, size))), strict=True)]
        sums = pa.array([halves(total)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([_task()], pa.int32()), sums], ["at", "part", "sums"])

    return run


def _partial_means(size: int, of: Callable) -> Callable:
    """A row for each task: column sums of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(of(matrix(batch, size)).sum(axis=0) for batch in batches)
        if not isinstance(total, int):
            sums = pa.array([total], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([_task()], pa.int32()), sums], ["at", "part", "sums"])

    return run


def _partial_scatter(size: int, of: Callable) -> Callable:
    """For each task, the rows of the scatter of what ``of`` gives, which is centred."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = of(matrix(batch, size))
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            at = pa.array(range(len(total)), pa.int32())
            part = pa.array([_task()] * len(total), pa.int32())
            yield pa.RecordBatch.from_arrays([at, part, pa.array(list(total), pa.list_(pa.float64()))], ["at", "part", "sums"])

    return run


def _covariance(rows: DataFrame, size: int, of: Callable, n: int):
    import numpy as np

    partial = rows.select("v").mapInArrow(_partial_scatter(size, of), "at int, part int, sums array<double>")
    return np.array([r.sums for r in sorted(array_sums(partial, ["at"]).collect())]) / n


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """One row per vector and component up to ``most``: ``id, component, n, deviation, whitened, explained,
    identity_error``."""
    import numpy as np

    spark = vectors.sparkSession
    rows, size, n = usable(vectors, id_col, vector_col)
    if not n:
        return spark.createDataFrame([], _OUT)
    exact = rows.select("v").mapInArrow(_partial_sums(size, lambda v: whole(v, FACTOR, OFFSET)), "at int, part int, sums array<long>")
    sums = joined(array_sums(exact, ["at"]).first().sums)
    middle = lambda v: centred(whole(v, FACTOR, OFFSET), n, sums)
    cov = _covariance(rows, size, lambda v: middle(v)[1], n)
    values, axes = one_sided_jacobi(pivoted_cholesky(cov)[0])
    k = min(most, len(values))
    if not k:
        return spark.createDataFrame([], _OUT)
    turn, share = axes[:, :k] / np.sqrt(values[:k]), values[:k] / np.trace(cov)
    project = lambda v: middle(v)[1] @ turn
    means = rows.select("v").mapInArrow(_partial_means(size, project), "at int, part int, sums array<double>")
    mean = np.array(array_sums(means, ["at"]).first().sums) / n
    error = float(np.abs(_covariance(rows, size, lambda v: project(v) - mean, n) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, x = middle(matrix(batch, size))
            each = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [
                batch.column("id").take(each),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * k, n, np.int64)),
                pa.array(deviations(off), pa.int64()).take(each),
                pa.array((x @ turn).ravel()),
                pa.array(np.tile(share, len(x))),
                pa.array(np.full(len(x) * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("id", "v").mapInArrow(run, _OUT)
