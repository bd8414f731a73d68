"""Embedding whitening from variances alone: the polarisation identity.

A variance needs no product of two dimensions, and

    cov(a, b) = (var(a + b) - var(a) - var(b)) / 2,

so sums of squares of every dimension and of every sum of two dimensions give the
whole covariance matrix.  Entries become whole numbers first, values are centred
by a whole number near their mean before they are squared, and squares are added
exactly: the matrix has no rounding but that of its last division, whatever the
number of rows and however Spark adds them up.

Passes over the vectors: sums, squares, the covariance of the result, the result.
Only numbers per dimension and pair of dimensions reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialize, release

#: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: An x beyond this is no entry: squares of its sums could not be added exactly in 38 digits.
LARGEST = 1 << 40
#: A component whose variance is under this share of the greatest one is rounding, not a direction of the data.
FLAT = 1e-13

Vectors = tuple[np.ndarray, np.ndarray]


def vectors(column: pa.Array, dimension: int | None = None) -> Iterator[Vectors]:
    """(rows, x) of the vectors of a batch that remain, by dimension: row numbers and their whole numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
    for size in np.unique(lengths[lengths > 0]) if dimension is None else [dimension]:
        rows = np.flatnonzero(lengths == size)
        if size == 0 or not len(rows):
            continue
        c = flat[offsets[rows][:, None] + np.arange(size)]
        with np.errstate(invalid="ignore", over="ignore"):
            x = np.floor(SCALE * c) + SHIFT
            good = (np.abs(x) < LARGEST).all(axis=1)
        yield rows[good], x[good].astype(np.int64)


def exact_sums(y: np.ndarray) -> list[int]:
    """Sums over the rows of y_a squared, then of (y_a + y_b) squared for every a < b, exactly."""
    n, dims = y.shape
    most = 2 * int(np.abs(y).max(initial=0)) + 1
    if most * most > 1 << 62:
        y = y.astype(object)
    else:
        step = max(1, (1 << 62) // (most * most))
        if step < n:
            return [sum(k) for k in zip(*(exact_sums(y[at : at + step]) for at in range(0, n, step)), strict=True)]
    # Squares below 2^53 in all are as exact in doubles, which numpy multiplies faster.
    if y.dtype == np.int64 and most * most * n < 1 << 53:
        y = y.astype(np.float64)
    squares = (y * y).sum(axis=0)
    out = [int(v) for v in squares]
    for a in range(dims - 1):
        pairs = y[:, a : a + 1] + y[:, a + 1 :]
        pairs *= pairs
        out += map(int, pairs.sum(axis=0))
    return out


def _first_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and sums of x, once a task for every dimension of its vectors."""
    found: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for rows, x in vectors(batch["vector"]):
            if len(rows):
                n, total = found.get(x.shape[1], (0, np.zeros(x.shape[1], object)))
                found[x.shape[1]] = (n + len(rows), total + x.sum(axis=0).astype(object))
    size, axis, n, total = [], [], [], []
    for dims, (rows, sums) in found.items():
        size += [dims] * dims
        axis += range(dims)
        n += [rows] * dims
        total += map(int, sums)
    yield pa.RecordBatch.from_arrays(
        [pa.array(size, pa.int32()), pa.array(axis, pa.int32()), pa.array(n, pa.int64()), pa.array(total, pa.decimal128(38, 0))],
        ["dims", "axis", "n", "total"],
    )


def _squares(centre: np.ndarray):
    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for rows, x in vectors(batch["vector"], len(centre)):
                for at in range(0, len(rows), 4096):
                    part = exact_sums(x[at : at + 4096] - centre)
                    total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
        total = total or []
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(total)), pa.int32()), pa.array(total, pa.decimal128(38, 0))], ["k", "total"]
        )

    return squares


@dataclass(frozen=True)
class Whitening:
    """The fitted map: component k of a vector is (x - mean) . directions[:, k]."""

    n: int
    #: Sums of x, and the whole numbers that centre it.
    sums: tuple[int, ...]
    centre: np.ndarray
    #: Unit eigenvectors as columns and their variances, greatest first, and the trace.
    axes: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    def whole(self) -> np.ndarray:
        """Which components are directions of the data; the others have no variance to divide by."""
        return self.variances > FLAT * max(self.trace, 0.0)

    def project(self, x: np.ndarray) -> np.ndarray:
        """The whitened components of whole-number vectors; NaN where a component is flat."""
        rest = np.array([(s - self.n * int(c)) / self.n for s, c in zip(self.sums, self.centre, strict=True)])
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.whole(), 1 / np.sqrt(self.variances), np.nan)
        return ((x - self.centre).astype(np.float64) - rest) @ self.axes * scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Of each vector the sum over dimensions of (n x - S) squared, exactly; None beyond 38 digits."""
        y = x - self.centre
        rest = [s - self.n * int(c) for s, c in zip(self.sums, self.centre, strict=True)]  # from 0 to n - 1
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        d = y * np.int64(self.n) - np.array(rest, np.int64) if most * most * self.dims < 1 << 62 else y.astype(object) * self.n - np.array(rest, object)
        return [int(v) if v < 10**38 else None for v in (d * d).sum(axis=1)]


def covariance(n: int, sums: list[int], squares: list[int]) -> np.ndarray:
    """The matrix, divisor n, from sums of centred values and of squares in the order of ``exact_sums``."""
    dims = len(sums)
    own = [n * q - s * s for q, s in zip(squares, sums, strict=False)]
    v = np.zeros((dims, dims))
    k = dims
    for a in range(dims):
        v[a, a] = own[a] / (n * n)
        for b in range(a + 1, dims):
            both = n * squares[k] - (sums[a] + sums[b]) ** 2
            v[a, b] = v[b, a] = (both - own[a] - own[b]) / (2 * n * n)
            k += 1
    return v


def fit(df: DataFrame, vector: str = "embedding") -> Whitening | None:
    """Fit on every vector of ``df``; None if none remains.

    A vector remains when it is not null, not empty and holds no null, NaN, infinite
    or unusable entry (one whose x is beyond 2^40).  Of vectors of several lengths
    those of the most frequent length remain, the longer one at a tie.  Repeated
    vectors count each.  Columns other than ``vector`` are not read.
    """
    rows = df.select(F.col(vector).alias("vector"))
    first = rows.mapInArrow(_first_sums, "dims int, axis int, n long, total decimal(38,0)")
    first = materialize(first.groupBy("dims", "axis").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "sums")
    usual = first.where("axis = 0").orderBy(F.desc("n"), F.desc("dims")).first()
    if usual is None:
        release(first)
        return None
    n, sums = usual.n, [int(r.total) for r in first.where(F.col("dims") == usual.dims).orderBy("axis").collect()]
    release(first)
    centre = np.array([s // n for s in sums], np.int64)
    parts = rows.mapInArrow(_squares(centre), "k int, total decimal(38,0)").groupBy("k").agg(F.sum("total").alias("total"))
    squares = [int(t) for _, t in sorted(parts.collect())]
    v = covariance(n, [s - n * int(c) for s, c in zip(sums, centre, strict=True)], squares)
    variances, axes = np.linalg.eigh(v)
    order = np.argsort(-variances, kind="stable")
    return Whitening(n, tuple(sums), centre, axes[:, order], np.maximum(variances[order], 0), math.fsum(np.diag(v)))


def _moments(model: Whitening, components: int):
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(components), np.zeros((components, components))
        for batch in batches:
            for rows, x in vectors(batch["vector"], model.dims):
                w = model.project(x)[:, :components]
                total += w.sum(axis=0)
                products += w.T @ w
        a, b = np.meshgrid(np.arange(components), np.arange(components), indexing="ij")
        ints = lambda v: pa.array(v.ravel().astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [ints(np.r_[np.full(components, -1), a.ravel()]), ints(np.r_[np.arange(components), b.ravel()]), pa.array(np.r_[total, products.ravel()])],
            ["a", "b", "value"],
        )

    return moments


def identity_error(df: DataFrame, model: Whitening, components: int, vector: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity; flat components left out.

    Whitened values are centred already; what rounding leaves of their mean is taken off.
    """
    parts = df.select(F.col(vector).alias("vector")).mapInArrow(_moments(model, components), "a int, b int, value double")
    found = {(a, b): v for a, b, v in parts.groupBy("a", "b").agg(F.sum("value").alias("value")).collect()}
    whole = [k for k in range(components) if model.whole()[k]]
    mean = {k: found[-1, k] / model.n for k in whole}
    errors = [abs(found[a, b] / model.n - mean[a] * mean[b] - (a == b)) for a in whole for b in whole]
    return max(errors, default=0.0)


def _whitened(model: Whitening, components: int):
    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in vectors(batch["vector"], model.dims):
                w = model.project(x)[:, :components]
                flat = pa.array(w.ravel(), mask=np.isnan(w).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * components), flat)
                deviations = pa.array(model.deviations(x), pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(rows)), deviations, lists], ["id", "deviation", "whitened"])

    return whitened


def whiten(df: DataFrame, components: int | None = None, vector: str = "embedding", row_id: str = "vec_id", model: Whitening | None = None) -> DataFrame:
    """One row per remaining vector: id, deviation decimal(38,0), whitened array<double> of the first ``components``.

    The map is fitted on ``df`` unless given.  Vectors that ``fit`` leaves out are
    dropped here too; null ids stay, repeated rows come each.  A component without
    variance is null.  An empty table gives an empty result.
    """
    schema = "id long, deviation decimal(38,0), whitened array<double>"
    model = model or fit(df, vector)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    kept = min(components or model.dims, model.dims)
    rows = df.select(F.col(row_id).cast("long").alias("id"), F.col(vector).alias("vector"))
    return rows.mapInArrow(_whitened(model, kept), schema)


def whitened_components(df: DataFrame, components: int = 8, vector: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """A row per remaining vector and component, with the facts of the fit.

    vec_id, component (from 1), n, deviation (null where it has no place in a long),
    whitened, explained (share of the trace; null if all vectors are equal), identity_error.
    """
    model = fit(df, vector)
    kept = min(components, model.dims) if model else 0
    error = identity_error(df, model, kept, vector) if model else 0.0
    shares = [float(e / model.trace) for e in model.variances[:kept]] if model and model.trace > 0 else [None] * kept
    rows = whiten(df, components, vector, row_id, model).select("id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    explained = F.array(*[F.lit(s).cast("double") for s in shares]).cast("array<double>")
    return rows.select(
        F.col("id").alias("vec_id"),
        (F.col("k") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        "whitened",
        F.get(explained, F.col("k")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
