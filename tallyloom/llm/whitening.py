"""Embedding whitening: principal components of a covariance that is summed with compensation, and vectors scaled by them.

Entries become whole numbers, so counts and sums are exact. Vectors are centred before they are multiplied, as double-doubles.
Their outer products go into a double-double sum by error-free transformations: a block of centred vectors is cut into slices of so few
bits that the product of two slices is exact in doubles, each exact product is added with its rounding error kept, and tasks hand on
high and low parts, which are merged in the same way, one matrix row a key. Only the covariance, whose size the vectors' length
gives, comes to the driver. It is solved there by LAPACK's syevd (reduction to tridiagonal form, then divide and conquer), and a
step of refinement in extended precision takes the low parts in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import drop_written, written
from tallyloom.llm.vectors import dimensions, padded, whole_vectors

SCALE = 256
COMPONENTS = 4
#: Vectors of a block, bits of a slice, and slices: 2 * 22 bits and 8 for the sum over a block are exact in a double's 53.
BLOCK, SLICE_BITS, SLICES = 256, 22, 5
LONG_MAX = (1 << 63) - 1


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def dd_add(hi: np.ndarray, lo: np.ndarray, more: np.ndarray, more_lo: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The double-double ``hi + lo`` with another one added."""
    s, e = two_sum(hi, more)
    return two_sum(s, e + (lo + more_lo))


def slices_of(hi: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
    """Matrices of ``SLICE_BITS`` bits on one grid each, which sum to ``hi + lo`` but for what lies below the last grid."""
    most = float(np.abs(hi).max(initial=0.0))
    found = []
    if most == 0:
        return [np.zeros_like(hi)] * SLICES
    top = int(np.frexp(most)[1])
    for k in range(1, SLICES + 1):
        grid = np.ldexp(1.5, top - SLICE_BITS * k + 52)
        piece = (hi + grid) - grid
        found.append(piece)
        hi, lo = two_sum(hi - piece, lo)
    return found


def add_outer(total: tuple[np.ndarray, np.ndarray], hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``total`` (high and low part) and the outer products of all rows of ``hi + lo``."""
    for at in range(0, len(hi), BLOCK):
        pieces = slices_of(hi[at : at + BLOCK], lo[at : at + BLOCK])
        for i in range(SLICES):
            for j in range(SLICES - i):
                total = dd_add(*total, pieces[i].T @ pieces[j])
    return total


@dataclass
class Centre:
    """Count and exact sums of the fit list, and its mean as double-doubles."""

    n: int
    sums: list[int]

    def __post_init__(self) -> None:
        means = [Fraction(s, max(1, self.n)) for s in self.sums]
        self.hi = np.array([float(m) for m in means])
        self.lo = np.array([float(m - Fraction(h)) for m, h in zip(means, self.hi.tolist())])

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high = x.astype(np.float64)
        # A number over 53 bits has a rest; 2 ** 63 itself is out of the range of the way back.
        low = np.zeros_like(high)
        large = np.abs(high) >= 2.0**53
        if large.any():
            low[large] = [float(int(a) - int(b)) for a, b in zip(x[large], high[large])]
        return dd_add(high, low, -self.hi, -self.lo)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of ``(n * x - S) ** 2``; none where one does not fit into a long."""
        reach = self.n * int(np.abs(x.astype(np.float64)).max(initial=0.0) + 1) + max(map(abs, self.sums), default=0)
        if reach * reach * max(1, x.shape[1]) <= LONG_MAX:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums)) for row in x]
        return [d if d <= LONG_MAX else None for d in exact]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), dims)


def _centre(fit: DataFrame, dims: int) -> Centre:
    """Sums are taken in two halves of 32 bits, so no task's part can overflow."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            parts = [pa.array(range(dims), pa.int32()), pa.array((x >> 32).sum(axis=0), pa.int64()), pa.array((x & 0xFFFFFFFF).sum(axis=0), pa.int64())]
            yield pa.RecordBatch.from_arrays(parts, names=["dim", "hi", "lo"])

    sums = fit.mapInArrow(of, "dim int, hi long, lo long").groupBy("dim").agg(F.sum("hi").alias("hi"), F.sum(F.col("lo").cast("decimal(38,0)")).alias("lo")).collect()
    by_dim = {r["dim"]: (r["hi"] << 32) + int(r["lo"]) for r in sums}
    return Centre(fit.count(), [by_dim.get(k, 0) for k in range(dims)])


def _summed(parts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tasks' ``at, hi, lo``, one matrix row each, merged by row: every task gives each row once."""

    def merge(table: pa.Table) -> pa.Table:
        dims = len(table.column("hi")[0])
        rows = [(_matrix(b.column("hi"), dims), _matrix(b.column("lo"), dims)) for b in table.to_batches()]
        hi, lo = np.zeros(dims), np.zeros(dims)
        for highs, lows in rows:
            for h, low in zip(highs, lows):
                hi, lo = dd_add(hi, lo, h, low)
        return pa.table({"at": table.column("at").slice(0, 1), "hi": pa.array([hi]), "lo": pa.array([lo])})

    merged = parts.groupBy("at").applyInArrow(merge, "at int, hi array<double>, lo array<double>").collect()
    merged.sort(key=lambda r: r["at"])
    return np.array([r["hi"] for r in merged]), np.array([r["lo"] for r in merged])


def _outer_sums(fit: DataFrame, dims: int, rows_of, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of outer products over the fit list, high and low part; ``rows_of`` gives the rows that are multiplied."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size)), np.zeros((size, size))
        some = False
        for batch in batches:
            some = True
            total = add_outer(total, *rows_of(_matrix(batch.column(0), dims)))
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total[0])), pa.array(list(total[1]))], names=["at", "hi", "lo"])

    return _summed(fit.mapInArrow(of, "at int, hi array<double>, lo array<double>"))


def eigen(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of the symmetric matrix ``hi + lo``.

    The largest entry of a vector is positive. Vectors of equal values are any that are at right angles.
    """
    v = hi.astype(np.longdouble) + lo
    v = (v + v.T) / 2
    values, found = np.linalg.eigh(v.astype(np.float64))
    x = found.astype(np.longdouble)
    size = float(np.abs(values).max(initial=0.0))
    for _ in range(2):
        rest = np.eye(len(v), dtype=np.longdouble) - x.T @ x
        s = x.T @ v @ x
        ritz = np.diag(s) / (1 - np.diag(rest))
        gap = ritz[None, :] - ritz[:, None]
        apart = np.abs(gap) > size * len(v) * 1e-14
        step = np.where(apart, (s + ritz[None, :] * rest) / np.where(apart, gap, 1), rest / 2)
        x = x + x @ step
        values = ritz
    x = x / np.sqrt((x * x).sum(axis=0))
    order = np.argsort(-values, kind="stable")
    values, x = values[order].astype(np.float64), x[:, order].astype(np.float64)
    signs = np.sign(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])]) if len(x) else np.ones(0)
    return values, x * np.where(signs == 0, 1, signs)


@dataclass
class Whitening:
    """What was fitted. ``scaled`` has a component a column, over the root of its eigenvalue; zeros where nothing varies."""

    centre: Centre
    values: np.ndarray
    trace: float
    scaled: np.ndarray
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        hi, lo = self.centre.centred(x)
        return hi @ self.scaled + lo @ self.scaled


def fit_whitening(vectors: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """Fitted on each distinct vector of ``vectors`` (``v``, whole numbers of length ``dims``) once."""
    fit = written(vectors.select("v").distinct(), "fit")
    centre = _centre(fit, dims)
    if not centre.n or not dims:
        drop_written(fit)
        return Whitening(centre, np.zeros(0), 0.0, np.zeros((dims, 0)))
    hi, lo = _outer_sums(fit, dims, centre.centred, dims)
    trace = float(sum(Fraction(float(a)) + Fraction(float(b)) for a, b in zip(np.diag(hi), np.diag(lo))) / centre.n)
    values, x = eigen(hi, lo)
    values = values / centre.n
    kept = min(components, dims)
    live = values[:kept] > max(trace, 0.0) * dims * 1e-15
    scaled = np.where(live, x[:, :kept] / np.sqrt(np.where(live, values[:kept], 1)), 0.0)
    fitted = Whitening(centre, values[:kept], trace, scaled)

    def whitened(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = fitted.whitened(rows)
        return w, np.zeros_like(w)

    # Whitened vectors are centred already: they are linear in vectors that are.
    again, _ = _outer_sums(fit, dims, whitened, kept)
    fitted.identity_error = float(np.abs(again / centre.n - np.eye(kept))[np.ix_(live, live)].max(initial=0.0))
    drop_written(fit)
    return fitted


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every row that takes part.

    Rows with a null vector, or null or non-finite entries, are left out. Shorter vectors count as filled up with zeros.
    Entries over ``256 * c`` of a long's range take its end. Repeated rows each give theirs and count once in the fit; a null id is kept. A
    component along which nothing varies has ``whitened`` and ``explained`` 0 and is no part of ``identity_error``. A ``deviation``
    that does not fit into a long is null. Other columns are not read. An empty table gives an empty result.
    """
    named = whole_vectors(rows, id_col, vector_col)
    dims = dimensions(named)
    whole = named.select("id", padded(F.transform("v", lambda c: F.floor(c * SCALE)), dims, F.lit(0).cast("long")).alias("v"))
    fitted = fit_whitening(whole, dims, components)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = fitted.scaled.shape[1]
        explained = fitted.values / fitted.trace if fitted.trace > 0 else np.zeros(kept)
        for batch in batches:
            x = _matrix(batch.column("v"), dims)
            many = len(x) * kept
            order = pa.array(np.repeat(np.arange(len(x)), kept))
            columns = [
                batch.column("id").take(order), pa.array(np.tile(np.arange(1, kept + 1), len(x)), pa.int32()), pa.array([fitted.centre.n] * many, pa.int64()),
                pa.array(fitted.centre.deviations(x), pa.int64()).take(order), pa.array(fitted.whitened(x).ravel(), pa.float64()),
                pa.array(np.tile(np.maximum(explained, 0.0), len(x)), pa.float64()), pa.array([fitted.identity_error] * many, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whole.mapInArrow(of, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
