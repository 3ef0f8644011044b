"""Embedding whitening (PCA): distributed sums, eigenvectors on the driver.

The table is passed over for its vectors' sums, for the centred products and
for the projection; tasks give partial sums and nothing row by row reaches
the driver.  What the driver holds is a matrix of dimension x dimension,
whatever the number of rows.  Its leading eigenvalues come from a Householder
tridiagonal form and bisection on Sturm counts, its eigenvectors from inverse
iteration, where vectors of close eigenvalues are made orthogonal again.

Vectors are integers here, ``floor(256 c)``, and centring happens on
``n x - S`` in integers, so no rounding enters before the products.

Edge rows: a row whose vector is null or holds a null, a NaN or an infinity
is left out, of the fit and of the result.  A vector shorter than the longest
counts as zero beyond its end (an empty one as all zeros).  Repeated vectors
count once in the fit and repeat their results; ids may be null or repeated.
Components are those whose eigenvalue is above rounding (a constant table
has none, so its result is empty); an empty table gives no rows.  Columns
other than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import short_batches, staged

SCALE = 256
# Rows of a batch handled at once hold about this many numbers.
CELLS = 1 << 20
_EPS = np.finfo(np.float64).eps


# --- eigenvectors of a symmetric matrix -------------------------------------

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder form of a symmetric matrix: its diagonal, its off-diagonal
    and the unit reflection vectors (reflection k leaves the first k + 1
    coordinates alone)."""
    a = a.copy()
    n = len(a)
    mirrors = []
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(x)
        v = x / size if size > 0 else np.zeros_like(x)
        mirrors.append(v)
        if size > 0:
            # Two-sided reflection of the remaining block as a rank-two update.
            block = a[k + 1:, k + 1:]
            p = 2 * (block @ v)
            w = p - (v @ p) * v
            block -= np.outer(v, w) + np.outer(w, v)
            a[k + 1:, k] -= 2 * v * (v @ a[k + 1:, k])
            a[k, k + 1:] = a[k + 1:, k]
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def sturm_count(d: np.ndarray, e: np.ndarray, x: float) -> int:
    """How many eigenvalues of the tridiagonal matrix are below ``x``."""
    tiny = _EPS * (np.abs(e).max(initial=0.0) + np.abs(d).max(initial=0.0)) + np.finfo(np.float64).tiny
    count, q = 0, 1.0
    for i in range(len(d)):
        q = d[i] - x - (e[i - 1] * e[i - 1] / q if i else 0.0)
        if abs(q) < tiny:
            q = -tiny
        count += q < 0
    return count


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` largest eigenvalues, falling, by bisection."""
    off = np.concatenate([[0.0], np.abs(e), [0.0]])
    lo0, hi0 = float((d - off[:-1] - off[1:]).min()), float((d + off[:-1] + off[1:]).max())
    found = []
    for k in range(min(most, len(d))):
        rank = len(d) - k  # the eigenvalue that has rank - 1 below it
        lo, hi = lo0, found[-1] if found else hi0 + _EPS * (1 + abs(hi0))
        while True:
            mid = lo + (hi - lo) / 2
            if not lo < mid < hi:
                break
            if sturm_count(d, e, mid) >= rank:
                hi = mid
            else:
                lo = mid
        found.append(hi)
    return np.array(found)


def _solve_shifted(d: np.ndarray, e: np.ndarray, x: float, b: np.ndarray) -> np.ndarray:
    """Solves (T - x I) y = b by elimination with row exchanges; a zero pivot
    counts as one of rounding size."""
    n = len(d)
    tiny = _EPS * (max(np.abs(d).max(), np.abs(e).max(initial=0.0)) or 1.0)
    upper = np.zeros((n, 3))  # a row's pivot and the two entries right of it
    y = b.copy()
    row = np.array([d[0] - x, e[0] if n > 1 else 0.0, 0.0])
    for i in range(n - 1):
        below = np.array([e[i], d[i + 1] - x, e[i + 1] if i + 2 < n else 0.0])
        if abs(below[0]) > abs(row[0]):
            row, below = below, row
            y[i], y[i + 1] = y[i + 1], y[i]
        if abs(row[0]) < tiny:
            row[0] = tiny
        f = below[0] / row[0]
        upper[i] = row
        row = np.array([below[1] - f * row[1], below[2] - f * row[2], 0.0])
        y[i + 1] -= f * y[i]
    if abs(row[0]) < tiny:
        row[0] = tiny
    upper[n - 1] = row
    for i in range(n - 1, -1, -1):
        right = upper[i, 1] * y[i + 1] if i + 1 < n else 0.0
        right += upper[i, 2] * y[i + 2] if i + 2 < n else 0.0
        y[i] = (y[i] - right) / upper[i, 0]
    return y


def inverse_iteration(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit eigenvector (column) for each of the falling ``values``.  Values
    nearer to their neighbour than a thousandth of the matrix's norm are a
    cluster, whose vectors are made orthogonal to each other in each step."""
    n = len(d)
    norm = max(np.abs(d).max(), np.abs(e).max(initial=0.0))
    out = np.zeros((n, len(values)))
    seed = np.random.default_rng(12)
    begin = 0
    for k, x in enumerate(values):
        if k and values[k - 1] - x > 1e-3 * norm:
            begin = k
        # Equal shifts would give equal vectors before they are made orthogonal.
        shift = x - (k - begin) * 4 * _EPS * norm
        y = seed.standard_normal(n)
        for _ in range(6):
            # Twice, so that what the first subtraction leaves by rounding goes too.
            for _ in range(2):
                y -= out[:, begin:k] @ (out[:, begin:k].T @ y)
            y = _solve_shifted(d, e, shift, y / np.linalg.norm(y))
        for _ in range(2):
            y -= out[:, begin:k] @ (out[:, begin:k].T @ y)
        out[:, k] = y / np.linalg.norm(y)
    return out


def leading_eigenpairs(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of a symmetric matrix, falling, and
    unit eigenvectors as columns."""
    if not len(a):
        return np.zeros(0), np.zeros((0, 0))
    # Entries near one, so no product under- or overflows.
    unit = np.abs(a).max() or 1.0
    d, e, mirrors = tridiagonal(a / unit)
    values = leading_eigenvalues(d, e, most)
    vectors = inverse_iteration(d, e, values)
    for k in range(len(mirrors) - 1, -1, -1):
        v = mirrors[k]
        vectors[k + 1:] -= 2 * np.outer(v, v @ vectors[k + 1:])
    return values * unit, vectors


# --- sums over the table ----------------------------------------------------

def integers(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): the rows with a whole finite vector, as floor(256 c)."""
    c = F.col(vector_col).cast("array<double>")
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (table.where(F.col(vector_col).isNotNull() & ~bad)
            .select(F.col(id_col).alias("id"), F.transform(c, lambda v: F.floor(v * SCALE)).alias("x")))


def _matrices(column: pa.Array, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    """Consecutive vectors as (first index, int64 matrix), zeros beyond a short one's end."""
    rows = max(1, CELLS // max(1, dims))
    for at in range(0, len(column), rows):
        part = column.slice(at, rows)
        size = np.diff(part.offsets.to_numpy()).astype(np.int64)
        flat = part.flatten().to_numpy()
        if (size == dims).all():
            yield at, flat.reshape(len(part), dims)
            continue
        out = np.zeros((len(part), dims), np.int64)
        out[np.repeat(np.arange(len(part)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        yield at, out


class Centre:
    """The fit list's number of vectors and exact sums."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.dims = len(sums)

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n x - S: 64-bit integers where they and the sum of their squares
        fit, else Python's."""
        most = self.n * max(abs(int(x.min(initial=0))), int(x.max(initial=0))) + max(map(abs, self.sums), default=0)
        if most * most * max(1, self.dims) < 1 << 63:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n in double precision."""
        return self.apart(x).astype(np.float64) / self.n


def _centre(fit: DataFrame, dims: int) -> Centre:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            n += batch.num_rows
            for _, x in _matrices(batch.column(0), dims):
                # Halves, so that sums of any longs stay exact.
                high += (x >> 32).sum(axis=0)
                low += (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(-1, dims), pa.int32()), pa.array(np.concatenate([[0], high])),
                 pa.array(np.concatenate([[n], low]))], ["i", "high", "low"])

    whole = "decimal(38,0)"
    parts = fit.mapInArrow(run, "i int, high long, low long").groupBy("i").agg(
        F.sum(F.col("high").cast(whole)).alias("high"), F.sum(F.col("low").cast(whole)).alias("low"))
    got = {r["i"]: (int(r["high"]) << 32) + int(r["low"]) for r in parts.collect()}
    return Centre(got.get(-1, 0), [got[i] for i in range(dims)] if got else [0] * dims)


def _products(fit: DataFrame, centre: Centre, project: np.ndarray | None = None) -> np.ndarray:
    """The covariance (divisor n) of the fit list's centred vectors, or of
    their projections.  A task gives its sum of products, one row of the matrix
    a record; rows of one number meet again by partial sums."""
    size = centre.dims if project is None else project.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros((size, size)), False
        for batch in batches:
            for _, x in _matrices(batch.column(0), centre.dims):
                z = centre.centred(x)
                z = z if project is None else z @ project
                total += z.T @ z
                any_rows = True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(list(total))], ["i", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            sums = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, size)
            for i, s in zip(batch.column(0).to_pylist(), sums):
                held[i] = held[i] + s if i in held else s.copy()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()))], ["i", "sums"])

    schema = "i int, sums array<double>"
    parts = fit.mapInArrow(run, schema).repartition("i").mapInArrow(add, schema)
    out = np.zeros((size, size))
    for r in parts.toLocalIterator():
        out[r["i"]] += r["sums"]
    out /= max(1, centre.n)
    return (out + out.T) / 2


class Whitening:
    """A fitted whitening: ``axes`` are eigenvectors over the square roots of
    their eigenvalues, ``values`` the eigenvalues, ``trace`` the covariance's,
    ``identity_error`` how far the fit list's whitened covariance is from the
    identity."""

    def __init__(self, centre: Centre, values: np.ndarray, axes: np.ndarray, trace: float, identity_error: float):
        self.centre, self.values, self.axes = centre, values, axes
        self.trace, self.identity_error = trace, identity_error


def fit_whitening(rows: DataFrame, components: int = 4) -> Whitening:
    """Fits on the distinct vectors of ``rows(id, x)`` (see ``integers``)."""
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    # Zeros at the end don't make a vector another one.
    whole = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))
    fit = staged(rows.select(whole.alias("x")).distinct())
    centre = _centre(fit, dims)
    v = _products(fit, centre)
    values, vectors = leading_eigenpairs(v, components)
    real = values > dims * _EPS * max(1e-300, np.trace(v))
    values, vectors = values[real], vectors[:, real]
    axes = vectors / np.sqrt(values)
    error = 0.0
    if len(values):
        error = float(np.abs(_products(fit, centre, axes) - np.eye(len(values))).max())
    return Whitening(centre, values, axes, float(np.trace(v)), error)


def whiten(table: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, n, deviation, whitened, explained, identity_error) of every
    row with a whole finite vector.

    whitened and explained are arrays, one entry a component by falling
    eigenvalue (all rows alike; fewer than ``components`` where the rest of
    the covariance is zero).  deviation is the exact sum of (n x - S)^2 as a
    long, null where it is no long."""
    short_batches(table.sparkSession)
    rows = integers(table, id_col, vector_col)
    model = fit_whitening(rows, components)
    shared = table.sparkSession.sparkContext.broadcast((model.centre, model.axes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, axes = shared.value
        for batch in batches:
            for at, x in _matrices(batch.column(1), centre.dims):
                apart = centre.apart(x)
                deviation = (apart * apart).sum(axis=1)
                if apart.dtype == object:
                    deviation = [int(q) if q < 1 << 63 else None for q in deviation]
                out = apart.astype(np.float64) / centre.n @ axes
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * axes.shape[1], pa.int32()),
                                                 pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), pa.array(deviation, pa.int64()), lists],
                                                 ["id", "deviation", "whitened"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, deviation long, whitened array<double>")
    share = [float(e / model.trace) for e in model.values]
    return out.select(F.col("id").alias(id_col), F.lit(model.centre.n).cast("long").alias("n"), "deviation", "whitened",
                      F.lit(share).cast("array<double>").alias("explained"),
                      F.lit(model.identity_error).alias("identity_error"))
