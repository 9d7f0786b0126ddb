"""Whitening of embeddings by a block Jacobi-Davidson eigensolver over distributed rows.

The covariance is never built. Its product with a few vectors is one Spark job: every task multiplies its
centred rows by the vectors and their images back again, and Spark adds the tasks' sums cell by cell. The driver
holds matrices of width times a few dozen columns, whatever the number of rows.

Outer loop: Rayleigh-Ritz in the subspace built so far gives the leading pairs and their residuals. Pairs
whose residual has reached double precision are locked and projected out. For each of the others the correction
equation (I - QQ') (V - theta I) (I - QQ') t = -r is solved roughly by a few steps of MINRES, with the
products of all pairs' steps in one job, and the corrections, made orthogonal, extend the subspace. A
full subspace is restarted from its leading Ritz vectors.

Rows are centred before they are multiplied: n * x - S is exact in whole numbers, so a large common offset costs no
digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shiftledger.llm.common import stored

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
# Vectors carried beyond those asked for, so that neighbours of the last one do not slow it down.
GUARD = 4
INNER_STEPS = 4
OUTER_STEPS = 60
SUBSPACE = 4
# Residuals relative to the largest eigenvalue, in units of the rounding of doubles.
RESIDUAL = 64
_EPS = float(np.finfo(float).eps)


class NotConverged(ArithmeticError):
    """Residuals did not reach double precision within the steps allowed."""


def whole_rows(vectors: DataFrame) -> DataFrame:
    """vec_id and ``x``: floor(64 c) + 1000000 of every component c, taken as a double.

    Rows whose vector is missing or holds a missing or non-finite entry are dropped; a missing vec_id is
    kept. Other columns are left aside.
    """
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    whole = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET).cast("long"))
    return vectors.where(F.col("embedding").isNotNull() & ~bad).select(
        F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x")
    )


def filled(x: Column, width: int) -> Column:
    """Vectors of one width: shorter ones are filled up as if they held zeros."""
    missing = F.lit(width) - F.size(x)
    return F.when(missing > 0, F.concat(x, F.array_repeat(F.lit(OFFSET).cast("long"), missing))).otherwise(x)


def cell_sums(rows: DataFrame, part: Callable[[Iterator[np.ndarray]], np.ndarray], kind: str) -> list:
    """Sums over all tasks of the array that ``part`` makes of a task's matrices, cell by cell.

    A task sends one array, Spark adds them: the driver gets one number a cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = part(_matrix(b.column("x")) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_pydict({"values": pa.array([cells.tolist()])})

    per_task = rows.select("x").mapInArrow(run, f"values array<{kind}>")
    cell = per_task.select(F.posexplode("values").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    return [v for _, v in sorted((r["i"], r["v"]) for r in cell.collect())]


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one width as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class CentredRows:
    """The rows of a table of distinct vectors, centred, and their products with few vectors."""

    def __init__(self, rows: DataFrame, width: int):
        self.rows, self.width = rows, width

        def totals(parts: Iterator[np.ndarray]) -> np.ndarray:
            out = np.zeros(width + 1, np.int64)
            for x in parts:
                out[:width] += x.sum(0)
                out[width] += len(x)
            return out

        *sums, self.n = cell_sums(rows, totals, "long")
        self.sums = np.array(sums, np.int64)

    def _summed(self, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
        """The sum over all rows of what ``part`` gives for a matrix of centred rows, divided by n."""
        n, sums = self.n, self.sums

        def total(parts: Iterator[np.ndarray]) -> np.ndarray:
            out = np.zeros(shape)
            for x in parts:
                out += part(deviations(x, n, sums).astype(np.float64) / n)
            return out.ravel()

        return np.array(cell_sums(self.rows, total, "double")).reshape(shape) / n

    def times(self, block: np.ndarray) -> np.ndarray:
        """Covariance times ``block`` (width x a few), in one job."""
        return self._summed(lambda y: y.T @ (y @ block), block.shape)

    def trace(self) -> float:
        return float(self._summed(lambda y: np.array([[(y * y).sum()]]), (1, 1))[0, 0])

    def second_moments(self, weights: np.ndarray) -> np.ndarray:
        """The covariance of the rows after projection on ``weights``."""
        return self._summed(lambda y: (y @ weights).T @ (y @ weights), (weights.shape[1],) * 2)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact; by way of the whole part of the mean, which keeps the steps small."""
    mean = sums // n
    return n * (x - mean) - (sums - n * mean)


def squared_length(y: np.ndarray) -> list[int | None]:
    """The sum of squares of every row, exact; None beyond 64 bits."""
    most = int(np.abs(y).max(initial=0))
    if most * most * y.shape[1] < 1 << 63:
        return (y * y).sum(1).tolist()
    exact = [sum(int(c) ** 2 for c in row) for row in y]
    return [s if s < 1 << 63 else None for s in exact]


def _apart(block: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what ``block`` adds to the bases; columns that add nothing go."""
    known = np.concatenate(bases, 1)
    kept = np.zeros((block.shape[0], 0))
    for column in block.T:
        norm = np.linalg.norm(column)
        if not norm:
            continue
        column = column / norm
        # Twice, as rounding leaves a rest the first time.
        for _ in range(2):
            column = column - known @ (known.T @ column) - kept @ (kept.T @ column)
        rest = np.linalg.norm(column)
        if rest > 1e-8:
            column = column / rest
            column = column - known @ (known.T @ column) - kept @ (kept.T @ column)
            kept = np.column_stack([kept, column / np.linalg.norm(column)])
    return kept


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """A few steps of MINRES for several symmetric systems at once, a column each.

    ``product`` applies every column's own operator; one call serves the step of all columns.
    """
    columns = right.shape[1]
    x = np.zeros_like(right)
    beta = np.linalg.norm(right, axis=0)
    on = beta > 0
    v_old, v = np.zeros_like(right), right / np.where(on, beta, 1)
    w_old, w = np.zeros_like(right), np.zeros_like(right)
    eta = beta.copy()
    c_old, c = np.ones(columns), np.ones(columns)
    s_old, s = np.zeros(columns), np.zeros(columns)
    beta = np.zeros(columns)
    for _ in range(steps):
        if not on.any():
            break
        p = product(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta * v_old
        beta_new = np.linalg.norm(p, axis=0)
        # Givens rotations of the tridiagonal matrix's new column.
        delta = c * alpha - c_old * s * beta
        rho2 = s * alpha + c_old * c * beta
        rho3 = s_old * beta
        rho1 = np.hypot(delta, beta_new)
        safe = np.where(rho1 > 0, rho1, 1)
        c_old, s_old, c, s = c, s, delta / safe, beta_new / safe
        w_old, w = w, (v - rho3 * w_old - rho2 * w) / safe
        on &= rho1 > 0
        x = x + np.where(on, c * eta, 0) * w
        eta = np.where(on, -s * eta, 0)
        v_old, v, beta = v, p / np.where(beta_new > 0, beta_new, 1), beta_new
        on &= beta_new > 0
    return x


def leading_pairs(
    product: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, seed: int = 1
) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``wanted`` largest eigenvalues, falling, their unit eigenvectors and the number of products.

    ``product`` applies a symmetric positive semidefinite matrix to the columns of a block.
    """
    wanted = min(wanted, width)
    calls = 0

    def times(block: np.ndarray) -> np.ndarray:
        nonlocal calls
        calls += 1
        return product(block)

    held = min(width, wanted + GUARD)
    none = np.zeros((width, 0))
    locked = none
    basis = _apart(np.random.default_rng(seed).standard_normal((width, held)), none)
    image = times(basis)
    least = np.inf
    stalled = 0
    for _ in range(OUTER_STEPS):
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values, kind="stable")
        values, turn = values[order], turn[:, order]
        basis, image = basis @ turn, image @ turn
        need = wanted - locked.shape[1]
        # Locked directions are projected out of the residuals as of the equations.
        rest = image[:, :need] - basis[:, :need] * values[:need]
        rest = rest - locked @ (locked.T @ rest)
        sizes = np.linalg.norm(rest, axis=0)
        if locked.shape[1] == 0:
            largest = max(values[0], 0.0)
        tolerance = RESIDUAL * _EPS * max(largest, np.finfo(float).tiny)
        open_ = sizes > tolerance
        # Rounding in the products may end above that: no gain any more far below single precision.
        worst = float(sizes.max(initial=0.0))
        stalled = stalled + 1 if worst > 0.5 * least else 0
        least = min(least, worst)
        if stalled >= 3 and worst <= 1e-12 * largest:
            open_[:] = False
        # Only a leading run is locked, so that no larger one is left behind.
        done = int(np.argmax(open_)) if open_.any() else len(open_)
        if done:
            locked = np.concatenate([locked, basis[:, :done]], 1)
            basis, image = basis[:, done:], image[:, done:]
            rest, values = rest[:, done:], values[done:]
            need -= done
            least, stalled = np.inf, 0
        if not need:
            break
        if locked.shape[1] + basis.shape[1] + need > SUBSPACE * held:
            basis, image = basis[:, : need + GUARD], image[:, : need + GUARD]
        rest, theta, ritz = rest[:, :need], values[:need], basis[:, :need]
        known = np.concatenate([locked, ritz], 1)
        off = lambda b: b - known @ (known.T @ b)
        correction = minres(lambda v: off(times(v) - v * theta), off(-rest), INNER_STEPS)
        more = _apart(correction, locked, basis)
        if not more.shape[1]:
            # Nothing new to add: a random direction, or the whole space is spanned.
            spare = np.random.default_rng(seed + calls).standard_normal((width, need))
            more = _apart(spare, locked, basis)
        if more.shape[1]:
            basis, image = np.concatenate([basis, more], 1), np.concatenate([image, times(more)], 1)
        else:
            image = times(basis)
    else:
        raise NotConverged(f"residual {least:.3g} of {largest:.3g} after {OUTER_STEPS} steps")
    # The locked vectors once more together: neighbours are turned apart and values come fresh.
    image = times(locked)
    small = locked.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values, kind="stable")
    return values[order], locked @ turn[:, order], calls


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error.

    One row per row of ``vectors`` that remains (see ``whole_rows``) and component. Equal vectors count once
    in the fit and each gets its rows. Shorter vectors count as filled up with zeros. Directions without
    variance (eigenvalues within rounding of zero) cannot be whitened and give no components, so a table whose
    vectors are all equal, like an empty one, gives no rows. ``deviation`` is NULL where it exceeds 64 bits.
    """
    spark = vectors.sparkSession
    rows = whole_rows(vectors)
    shape = rows.agg(F.max(F.size("x")).alias("width")).first()
    width = shape["width"] or 0
    rows = rows.withColumn("x", filled(F.col("x"), width))
    schema = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double"
    )
    if not width:
        return spark.createDataFrame([], schema)
    fit = CentredRows(stored(rows.select("x").distinct(), "fit"), width)
    trace = fit.trace()
    if not trace > 0:
        return spark.createDataFrame([], schema)
    values, axes, _ = leading_pairs(fit.times, width, components)
    some = values > width * _EPS * values[0]
    values, axes = values[some], axes[:, some]
    error = float(np.abs(fit.second_moments(axes / np.sqrt(values)) - np.eye(len(values))).max())

    n, sums = fit.n, fit.sums

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y = deviations(_matrix(b.column("x")), n, sums)
            z = (y.astype(np.float64) / n) @ axes / np.sqrt(values)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": b.column("vec_id"),
                    "deviation": pa.array(squared_length(y), pa.int64()),
                    "z": pa.array(z.tolist(), pa.list_(pa.float64())),
                }
            )

    seen = rows.mapInArrow(project, "vec_id long, deviation long, z array<double>")
    shares = F.array(*[F.lit(float(v / trace)) for v in values])
    return seen.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, "at").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
