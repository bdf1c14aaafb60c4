"""Embedding whitening by shifted CholeskyQR.

Entries become whole numbers, rows are centred by exact sums, and the centred rows Y are made
orthogonal by Gram passes: each pass solves the rows against the triangular factors so far, sums
Q'Q over all partitions, and adds one more Cholesky factor; the first ones are shifted so that they
cannot break down. The product R of the factors has Y's singular values and right vectors, so its SVD
gives the components. Tasks return sums of the size of one Gram matrix, which are added in two levels;
the driver holds a few of those and no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Entries that are handled at once in a task.
BLOCK_ENTRIES = 1 << 20
#: Shifted passes at most, Gram eigenvalues that count as orthogonal, and below which a direction is empty.
PASSES, NEAR_ONE, EMPTY = 10, 1e-8, 1e-12
_LIMB = 32


def _whole(batch: pa.RecordBatch, column: str, dim: int | None):
    """Row numbers and whole-number vectors of a batch's valid rows of ``dim`` entries, in blocks; all lengths if None."""
    lists = batch.column(column)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    empty = flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(empty | ~(np.abs(values) < 2.0**50))])
    ends = np.cumsum(sizes)
    valid = (sizes > 0) & (bad[ends] == bad[ends - sizes])
    for size in np.unique(sizes[valid]) if dim is None else [dim]:
        rows = np.flatnonzero(valid & (sizes == size))
        step = max(1, BLOCK_ENTRIES // int(size))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            taken = values[(ends[part] - size)[:, None] + np.arange(size)]
            yield part, np.floor(SCALE * taken).astype(np.int64) + OFFSET


def _column_sums(column: str):
    """Each task's sums by length and position, in two limbs, with rows and extreme values."""

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for _, x in _whole(batch, column, None):
                got = [np.full(x.shape[1], len(x)), (x >> _LIMB).sum(0), (x & ((1 << _LIMB) - 1)).sum(0), x.min(0), x.max(0)]
                old = found.get(x.shape[1])
                found[x.shape[1]] = got if old is None else [*(a + b for a, b in zip(old[:3], got[:3], strict=True)), np.minimum(old[3], got[3]), np.maximum(old[4], got[4])]
        for dim, made in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim)), pa.array(np.arange(dim)), *map(pa.array, made)], names=["dim", "pos", "n", "high", "low", "least", "most"])

    return run


class Fit:
    """What every task needs to centre rows and to bring them through the factors found so far."""

    def __init__(self, dim: int, n: int, sums: list[int], extent: int):
        self.dim, self.n, self.sums = dim, n, sums
        self.fits_long = n * extent < 2**62
        self.factors: list[np.ndarray] = []

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n*x-S, exact: long where that fits, else Python's whole numbers."""
        if self.fits_long:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def orthogonal(self, centred: np.ndarray) -> np.ndarray:
        for factor in self.factors:
            centred = solve_right(centred, factor)
        return centred


def solve_right(y: np.ndarray, r: np.ndarray, block: int = 32) -> np.ndarray:
    """Q with Q R = Y for an upper triangular R: columns from the left, in blocks."""
    q = np.array(y, order="F")
    for a in range(0, len(r), block):
        b = min(a + block, len(r))
        if a:
            q[:, a:b] -= q[:, :a] @ r[:a, a:b]
        for j in range(a, b):
            if j > a:
                q[:, j] -= q[:, a:j] @ r[a:j, j]
            q[:, j] /= r[j, j]
    return q


def _packed(part: int, n: int, *arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([n]), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], names=["part", "n", "sums", "products"])


_PACKED = "part long, n long, sums binary, products binary"


def _merge(rows, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and centred products of several (n, sums, products)."""
    n, sums, products = 0, np.zeros(width), np.zeros((width, width))
    for m, s, p in rows:
        s, p = np.frombuffer(s), np.frombuffer(p).reshape(width, width)
        if n and m:
            apart = s / m - sums / n
            products = products + np.outer(apart, apart) * (n * m / (n + m))
        n, sums, products = n + m, sums + s, products + p
    return n, sums, products


def _moments(vectors: DataFrame, column: str, fit: Fit, outcome, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and centred products of ``outcome(centred rows)`` over all valid rows, added in two levels."""

    def each(batches):
        parts = []
        for batch in batches:
            for _, x in _whole(batch, column, fit.dim):
                made = outcome(fit.deviations(x).astype(float) / fit.n)
                apart = made - made.mean(0)
                parts.append((len(made), made.sum(0), apart.T @ apart))
                parts = [_merge(parts, width)] if len(parts) > 1 else parts
        if parts:
            from pyspark import TaskContext

            yield _packed(TaskContext.get().partitionId(), *parts[0])

    def together(batches):
        n, sums, products = _merge((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("n", "sums", "products")), strict=True)), width)
        if n:
            yield _packed(0, n, sums, products)

    made = vectors.mapInArrow(each, _PACKED)
    few = max(1, math.isqrt(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = made.repartition(few, "part").mapInArrow(together, _PACKED).collect()
    return _merge(((r["n"], r["sums"], r["products"]) for r in rows), width)


def fit_rows(vectors: DataFrame, column: str) -> Fit | None:
    """Length, number and exact sums of the valid vectors; None if there are none."""
    totals = (
        vectors.mapInArrow(_column_sums(column), "dim long, pos long, n long, high long, low long, least long, most long")
        .groupBy("dim", "pos")
        .agg(*(F.sum(c).alias(c) for c in ("n", "high", "low")), F.min("least").alias("least"), F.max("most").alias("most"))
    )
    each = totals.groupBy("dim").agg(F.max("n").alias("n"), F.collect_list(F.struct("pos", "high", "low", "least", "most")).alias("cells"))
    top = each.orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not top:
        return None
    cells = sorted(top[0]["cells"])
    return Fit(top[0]["dim"], top[0]["n"], [(c["high"] << _LIMB) + c["low"] for c in cells], max(max(abs(c["least"]), abs(c["most"])) for c in cells))


def components(vectors: DataFrame, column: str, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of the covariance.

    Directions without variance, told from rounding by the Gram matrix of the orthogonal rows, have
    eigenvalue 0 and zero columns.
    """
    d, upper = fit.dim, np.eye(fit.dim)
    for made in range(PASSES):
        gram = _moments(vectors, column, fit, fit.orthogonal, d)[2]
        size = np.linalg.norm(gram, 2)
        if not size:
            return np.zeros(d), np.zeros((d, d))
        value, turn = np.linalg.eigh(gram)
        empty = (value < EMPTY * size) & (made > 0)
        if made >= 3 and (empty | (np.abs(value - 1) < NEAR_ONE)).all() or made == PASSES - 1:
            break
        full = made and value[0] > 0.1 * size  # far from breaking down: no shift needed any more
        shift = 0.0 if full else min(1e-2, 11 * (fit.n * d + d * (d + 1)) * 2.0**-53) * size
        # Empty directions hold rounding alone; adding their projector keeps it from growing.
        factor = np.linalg.cholesky(gram + shift * np.eye(d) + size * turn[:, empty] @ turn[:, empty].T).T
        fit.factors.append(factor)
        upper = factor @ upper
    # Y = Q R and Q'Q = T L T', so sqrt(L) T' R has Y's singular values to the last bit of Q's orthogonality.
    kept = ~empty
    _, single, right = np.linalg.svd((np.sqrt(value[kept])[:, None] * turn[:, kept].T) @ upper)
    eigen, axes = np.zeros(d), np.zeros((d, d))
    eigen[: len(single)] = single**2 / fit.n
    axes[:, : len(single)] = right[: len(single)].T
    return eigen, axes


def whitened(vectors: DataFrame, first: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per valid vector and component up to ``first``: id, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``, ``eigenvalue``.

    Valid are vectors that are neither null nor empty, hold no null or non-finite entry and none of
    2**50 or more, and have the length that most of them have (of lengths equally common, the largest);
    others are dropped. ``deviation`` is decimal(38, 0), null beyond it. Vectors of fewer than ``first``
    entries have as many components as entries. A component without variance has explained 0 and
    whitened null; where no component has variance, explained and identity_error are null. Repeated
    rows and null ids are rows of their own; other columns are ignored; no valid vector, no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    id_type = rows.schema["id"].dataType.simpleString()
    fit = fit_rows(rows.select("vector"), "vector")
    if fit is None:
        names = f"`{id_col}` {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double, eigenvalue double"
        return spark.createDataFrame([], names)
    eigen, axes = components(rows.select("vector"), "vector", fit)
    count, found = min(first, fit.dim), int((eigen[:first] > 0).sum())
    share = eigen[:count] / eigen.sum() if found else np.full(count, np.nan)
    onto = axes[:, :found] / np.sqrt(eigen[:found])
    error = None
    if found:
        n, _, products = _moments(rows.select("vector"), "vector", fit, lambda y: y @ onto, found)
        error = float(np.abs(products / n - np.eye(found)).max())

    def project(batches):
        for batch in batches:
            for at, x in _whole(batch, "vector", fit.dim):
                apart = fit.deviations(x)
                made = np.full((len(x), count), np.nan)
                made[:, :found] = (apart.astype(float) / fit.n) @ onto
                exact = apart if apart.dtype == object or fit.dim * int(np.abs(apart).max()) ** 2 >= 2**63 else None
                total = (apart.astype(object) ** 2).sum(1) if exact is not None else (apart * apart).sum(1)
                text = pa.array([str(v) if v < 10**38 else None for v in total.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(np.repeat(at, count))), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), text.take(pa.array(np.repeat(np.arange(len(x)), count))), pa.array(made.ravel(), from_pandas=True)],
                    names=["id", "component", "deviation", "whitened"],
                )

    made = rows.mapInArrow(project, f"id {id_type}, component int, deviation string, whitened double")
    pick = lambda values: F.element_at(F.array(*(F.lit(None if math.isnan(v) else float(v)).cast("double") for v in values)), F.col("component"))
    return made.select(
        F.col("id").alias(id_col),
        "component",
        F.lit(fit.n).cast("long").alias("n"),
        F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        "whitened",
        pick(share).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
        pick(eigen[:count]).alias("eigenvalue"),
    )
