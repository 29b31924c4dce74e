"""Whitening of embeddings with eigenvectors refined in mixed precision.

An entry c becomes the whole number floor(scale * c) + shift. Sums and products of whole numbers are exact: products
are taken of entries less their rounded mean, so nothing cancels, and the covariance follows from them as a fraction.
It does not depend on how the rows are dealt. Two passes over the rows gather it: n and the sums of each dimension,
then one d x d matrix from every task.

The eigenvectors begin as those of the covariance in 32-bit floats. Ogita's and Aishima's iteration corrects them by
matrix products alone, in doubles and then in extended precision: with R = I - X'X and S = X'AX, the correction of a
pair of vectors is (S_ij + l_j R_ij) / (l_j - l_i), its order of convergence is quadratic. Where two eigenvalues are
closer than the error bound of the step the quotient is meaningless; the vectors of such a cluster are kept
orthonormal and turned by the eigenvectors of the small matrix X_J'(A - m I)X_J, in which the cluster's common value
m is gone.

Only d x d numbers and one row for each dimension reach the driver, whatever the number of rows.

Edge cases: a vector that is null, empty, or holds null or non-finite entries is left out; vectors of different
lengths, and entries whose whole number is 2^52 or more, raise an error rather than give wrong numbers; repeated rows
count as often as they come; a null vec_id stays null; a component whose eigenvalue is 0 (fewer rows than dimensions,
constant dimensions) has a null `whitened`, as has a table of one row; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import materialize

EXACT = 1 << 53  # whole numbers up to here are exact as doubles
LARGEST = 1 << 52


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    """A list column without nulls as rows of a matrix."""
    return np.asarray(column.flatten()).astype(dtype, copy=False).reshape(len(column), -1)


def whole_numbers(embeddings: DataFrame, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """(vec_id, x array<long>) of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = np.floor(scale * np.asarray(lists.flatten()).astype(np.float64)) + shift
            if len(values) and np.abs(values).max() >= LARGEST:
                raise ValueError("an entry is too large to be a whole number without loss")
            lengths = np.asarray(lists.value_lengths()).astype(np.int32)
            x = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(values.astype(np.int64)))
            yield pa.record_batch([batch.column(0), x], names=["vec_id", "x"])

    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    taking_part = embeddings.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    return taking_part.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(
        run, "vec_id long, x array<bigint>")


def _summed(rows: DataFrame, per_batch: Callable[[np.ndarray], Iterator[np.ndarray]], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows of exact arrays of `shape` (their first dimension row by row), as Python integers.

    `per_batch` gives arrays of 64-bit integers below 2^62, or of Python integers, for the x of a batch.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, exact, bound = np.zeros(shape, np.int64), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            for part in per_batch(_matrix(batch.column(0), np.int64)):
                most = int(np.abs(part).max())
                if bound + most >= 1 << 62:
                    exact = total.astype(object) if exact is None else exact + total
                    total, bound = np.zeros(shape, np.int64), 0
                if part.dtype == object:
                    exact = part if exact is None else exact + part
                else:
                    total, bound = total + part, bound + most
        total = (total if exact is None else exact + total).reshape(-1)
        if total.any():
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at, pa.int64()), pa.array([str(v) for v in total[at].tolist()])], names=["at", "value"])

    found = rows.select("x").mapInArrow(run, "at long, value string").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out = np.zeros(int(np.prod(shape)), object)
    for at, value in found.toLocalIterator():  # as many rows as `shape` has entries, d x d at most
        out[at] = int(value)
    return out.reshape(shape)


def _products(x: np.ndarray) -> Iterator[np.ndarray]:
    """x'x exactly: by doubles in blocks whose sums stay below 2^53, or by Python integers."""
    most = int(np.abs(x).max())
    rows = len(x) if not most else min(len(x), EXACT // (most * most))
    if not rows:
        big = x.astype(object)
        yield big.T @ big
        return
    for at in range(0, len(x), rows):
        part = x[at:at + rows].astype(np.float64)
        yield (part.T @ part).astype(np.int64)


class Moments:
    """n, the sums of x, and the exact covariance numerators of n^2 V."""

    def __init__(self, rows: DataFrame):
        sizes = rows.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
        self.n, self.d = sizes[0], sizes[1] or 0
        if sizes[1] != sizes[2]:
            raise ValueError(f"vectors of {sizes[1]} and of {sizes[2]} entries")
        if not self.n:
            return

        def sums(x: np.ndarray) -> Iterator[np.ndarray]:
            most = int(np.abs(x).max())
            yield x.sum(axis=0) if most * len(x) < 1 << 62 else x.astype(object).sum(axis=0)

        self.sums = _summed(rows, sums, (self.d,))
        self.middle = np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)  # the rounded means
        middle = self.middle
        products = _summed(rows, lambda x: _products(x - middle), (self.d, self.d))
        self.rest = np.array([int(s) - self.n * int(m) for s, m in zip(self.sums, self.middle)], object)  # of the sums, after the middle
        self.numerators = products * self.n - np.outer(self.rest, self.rest)

    def covariance(self) -> np.ndarray:
        """V in extended precision."""
        square = self.n * self.n
        out = np.zeros((self.d, self.d), np.longdouble)
        for i in range(self.d):
            for j in range(i, self.d):
                first = self.numerators[i, j] / square
                out[i, j] = out[j, i] = np.longdouble(first) + np.longdouble(float(Fraction(self.numerators[i, j], square) - Fraction(first)))
        return out

    def trace(self) -> float:
        return sum(int(v) for v in np.diag(self.numerators)) / (self.n * self.n)


def _step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """One correction of the eigenvectors `x` of `a`, its largest entry, and how far `x` was from orthonormal."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    bound = 2 * (np.sqrt(((s - np.diag(values)) ** 2).sum()) + np.sqrt((a ** 2).sum()) * np.sqrt((r ** 2).sum()))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > bound
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    x = x + x @ e
    order = np.argsort(values)
    for cluster in np.split(order, np.flatnonzero(np.diff(values[order]) > bound) + 1):
        if len(cluster) == 1:
            continue
        own = x[:, cluster]
        small = own.T @ (a @ own - values[cluster].mean() * own)
        size = np.abs(small).max()
        if size > 0:
            turn = np.linalg.eigh(((small + small.T) / (2 * size)).astype(np.float64))[1]
            x[:, cluster] = own @ turn.astype(a.dtype)
    return x, float(np.abs(e).max()), float(np.abs(r).max())


def eigen(matrix: np.ndarray, steps: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision."""
    size = np.abs(matrix).max()
    if not size > 0:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    scaled = np.asarray(matrix, np.longdouble) / size
    x = np.linalg.eigh(scaled.astype(np.float32))[1]
    for precision in (np.float64, np.longdouble):
        a, x, last, idle = scaled.astype(precision), x.astype(precision), np.inf, 0
        rounding = len(a) * np.finfo(precision).eps
        for _ in range(steps):
            x, moved, skew = _step(a, x)
            idle = idle + 1 if skew <= 4 * rounding and moved > last / 2 else 0  # only rounding is left to correct
            if moved <= rounding or idle == 2:
                break
            last = moved
    for _ in range(2):  # the nearest orthonormal matrix: where values all but agree, rounding leaves the square of a correction
        x = x + x @ (np.eye(len(x), dtype=x.dtype) - x.T @ x) / 2
    values = (x * (scaled @ x)).sum(axis=0) / (x * x).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    return (values[order] * size).astype(np.float64), x.astype(np.float64)


def _covariance(rows: DataFrame, k: int) -> np.ndarray:
    """The covariance (divisor n) of the k entries of `w`, centred by their means before multiplying."""
    found = rows.agg(F.count("*").alias("n"), *[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(k)]).first()
    mean = np.array(found[1:], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = _matrix(batch.column(0), np.float64) - mean
            total += w.T @ w
        yield pa.record_batch([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["at", "value"])

    out = np.zeros(k * k)
    for at, value in rows.select("w").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value")).collect():  # k x k rows
        out[at] = value / found[0]
    return out.reshape(k, k)


def whitened(embeddings: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """(vec_id, component, n, deviation decimal, whitened, explained, identity_error) of each vector and component."""
    spark = embeddings.sparkSession
    rows = materialize(whole_numbers(embeddings, scale, shift), "whole-numbers")
    moments = Moments(rows)
    if not moments.n:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    n, k = moments.n, min(components, moments.d)
    values, vectors = eigen(moments.covariance())
    values, vectors = values[:k], vectors[:, :k]
    trace = moments.trace()
    positive = values > trace * moments.d * np.finfo(np.float64).eps
    onto = np.where(positive, vectors / np.sqrt(np.where(positive, values, 1)), 0)
    middle, rest = moments.middle, np.array([float(r) for r in moments.rest]) / n
    whole_rest = moments.rest
    most_rest = max(abs(int(r)) for r in whole_rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), np.int64) - middle
            most = n * int(np.abs(x).max()) + most_rest
            if most * most * x.shape[1] < 1 << 62:
                far = n * x - whole_rest.astype(np.int64)
                deviation = [str(v) for v in (far * far).sum(axis=1).tolist()]
            else:
                deviation = [str(sum(v * v for v in row)) for row in (x.astype(object) * n - whole_rest).tolist()]
            w = (x - rest) @ onto
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * k, pa.int32()), pa.array(w.ravel()))
            yield pa.record_batch([batch.column(0), pa.array(deviation), lists], names=["vec_id", "deviation", "w"])

    projected = materialize(rows.mapInArrow(run, "vec_id long, deviation string, w array<double>"), "whitened")
    apart = np.abs(_covariance(projected, k) - np.eye(k))[np.ix_(positive, positive)]
    error = float(apart.max()) if apart.size else None
    shares = F.array(*[F.lit(float(v / trace) if trace else None).cast("double") for v in values])
    known = F.array(*[F.lit(bool(p)) for p in positive])
    exploded = projected.select("vec_id", F.col("deviation").cast("decimal(38,0)").alias("deviation"), F.posexplode("w").alias("at", "value"))
    return exploded.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(F.get(known, F.col("at")), F.col("value")).alias("whitened"), F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))
