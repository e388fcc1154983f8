"""Whitening of embeddings by spectrum slicing.

Each entry becomes a whole number, so that sums and products of the fit are exact however Spark
orders them. The covariance (one row and column a dimension) is the only thing that the driver
solves: reflections bring it to tridiagonal form, where the signs of the pivots of an LDL^T
decomposition of the shifted matrix count the eigenvalues on each side of the shift (Sylvester).
Bisection by such counts isolates each leading eigenvalue, Rayleigh quotient iteration on the
covariance itself gives it and its vector, and counts beside it certify its number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampledger.llm.common import cut, table

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
LARGEST = 2.0**52  # beyond it a double holds whole numbers only
BATCH = 4096  # rows multiplied at once

_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_EPS = float(np.finfo(float).eps)


# --- the spectrum of a symmetric matrix, on the driver ---


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the same spectrum, by Householder reflections."""
    a = np.array(matrix, float)
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        size = v @ v
        if size == 0:
            continue
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v * (2 / size)
        w = p - v * ((p @ v) / size)
        a[k + 1 :, k + 1 :] = rest - np.outer(v, w) - np.outer(w, v)
        left = a[k + 1 :, k] - v * (2 / size * (v @ a[k + 1 :, k]))
        a[k + 1 :, k] = a[k, k + 1 :] = left
    return np.diag(a).copy(), np.diag(a, 1).copy()


def count_above(diagonal: np.ndarray, off: np.ndarray, shift: float) -> int:
    """Eigenvalues above ``shift``: positive pivots of the LDL^T decomposition of the shifted tridiagonal matrix."""
    least = _EPS * max(np.abs(diagonal).max(initial=0.0), np.abs(off).max(initial=0.0), 1e-300)
    above, pivot = 0, 1.0
    for d, square in zip((diagonal - shift).tolist(), [0.0, *(off * off).tolist()], strict=True):
        pivot = d - square / pivot
        if abs(pivot) < least:
            pivot = -least
        above += pivot > 0
    return above


def _solve(matrix: np.ndarray, shift: float, x: np.ndarray, size: float) -> np.ndarray:
    """(matrix - shift)^-1 x, of unit length; a shift that meets an eigenvalue exactly is moved by rounding."""
    for nudge in (0.0, 4.0, 64.0):
        try:
            z = np.linalg.solve(matrix - (shift + nudge * _EPS * size) * np.eye(len(matrix)), x)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(z).all() and (length := np.linalg.norm(z)) > 0:
            return z / length
    return x


def leading_pairs(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest positive eigenvalues, falling, and their unit vectors as columns.

    Eigenvalues that rounding cannot tell from zero are left out. Those that it cannot tell
    from one another share an interval; their vectors are made orthogonal within it.
    """
    d = len(matrix)
    size = float(np.abs(matrix).sum(axis=1).max()) if d else 0.0
    if size == 0:
        return np.zeros(0), np.zeros((d, 0))
    diagonal, off = tridiagonal(matrix)
    slack = 8 * d * _EPS * size
    start = np.random.default_rng(0)
    values, vectors = [], []
    for number in range(1, min(most, d) + 1):
        low, high = -slack, (values[-1] + slack if values else size + slack)
        if count_above(diagonal, off, slack) < number:
            break  # what is left is zero but for rounding
        while True:
            alone = count_above(diagonal, off, low) == number and count_above(diagonal, off, high) == number - 1
            if high - low <= slack or (alone and high - low <= 0.05 * abs(high)):
                found = _rayleigh(matrix, (low + high) / 2, vectors, values, size, slack, start)
                value = float(found @ matrix @ found)
                certain = count_above(diagonal, off, value - slack) >= number > count_above(diagonal, off, value + slack)
                if high - low <= slack or (certain and low - slack <= value <= high + slack):
                    break
            middle = (low + high) / 2
            if count_above(diagonal, off, middle) >= number:
                low = middle
            else:
                high = middle
        values.append(value)
        vectors.append(found)
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.array(vectors).reshape(-1, d).T[:, order]


def _rayleigh(matrix: np.ndarray, shift: float, vectors: list, values: list, size: float, slack: float, start) -> np.ndarray:
    near = [v for v, e in zip(vectors, values, strict=True) if abs(e - shift) <= 1e-6 * size]

    def apart(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for v in near:
                x = x - (v @ x) * v
        return x / np.linalg.norm(x)

    x = apart(start.standard_normal(len(matrix)))
    for _ in range(3):
        x = apart(_solve(matrix, shift, x, size))
    for _ in range(12):
        value = float(x @ matrix @ x)
        if np.linalg.norm(matrix @ x - value * x) <= slack / 8:
            x = apart(_solve(matrix, value, x, size))
            break
        x = apart(_solve(matrix, value, x, size))
    return x


# --- exact sums, in tasks ---


def _exact(values: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """Sums over rows, or the products ``values^T other``, as Python's whole numbers."""
    top = int(np.abs(values).max(initial=0))
    if other is None:
        whole = values if top * len(values) < 2**62 else values.astype(object)
        return whole.sum(axis=0).astype(object)
    if top * int(np.abs(other).max(initial=0)) * len(values) < 2**53:  # then doubles hold every partial sum
        return (values.astype(float).T @ other.astype(float)).astype(np.int64).astype(object)
    return values.astype(object).T @ other.astype(object)


def _vectors(batch: pa.RecordBatch, column: int, width: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _summed(df: DataFrame, width: int, shape: tuple[int, ...], of: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum over all rows' vectors of ``of``, an array of the given bounded shape; each task sends one row a cell."""
    exact = kind != "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = of(_vectors(batch.slice(at, BATCH), 0, width))
                total = part if total is None else total + part
        if total is not None:
            flat = total.ravel().tolist()
            cells = pa.array([Decimal(v) for v in flat], pa.decimal128(38, 0)) if exact else pa.array(flat, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), cells], ["cell", "value"])

    cells = df.select("x").mapInArrow(run, f"cell int, value {kind}").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros(int(np.prod(shape)), object if exact else float)
    for r in cells.collect():  # as many as the shape has cells
        out[r.cell] = int(r.value) if exact else r.value
    return out.reshape(shape)


class Whitening(NamedTuple):
    """``base`` + ``rest`` / n is the mean; ``weights`` take a centred vector to its whitened components."""

    n: int
    base: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    weights: np.ndarray
    trace: float
    identity_error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.base).astype(float) - self.rest.astype(float) / max(self.n, 1)) @ self.weights


def lattice(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x`` of rows whose vector has whole, finite entries: floor(64 c) + 1000000 of each entry c.

    A vector that is null or empty, or has a null, non-finite or unusably large entry (64 c of
    2^52 or more in size), gives no row.
    """
    vector = F.col(vector_col)
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * SCALE) < LARGEST))
    whole = F.transform(vector, lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("long"))
    return df.where(vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(sound, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"), whole.alias("x")
    )


def fit_whitening(vectors: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of ``vectors(x)`` of ``width`` entries each; every distinct vector counts once.

    Sums and products are whole numbers summed on Spark; ``width`` squared of them reach the driver.
    """
    fit = cut(vectors.select("x").distinct(), "fit-list")
    n = fit.count()
    if n == 0:
        return Whitening(0, np.zeros(width, np.int64), np.zeros(width), np.zeros(0), np.zeros((width, 0)), 0.0, 0.0)
    sums = _summed(fit, width, (width,), _exact, "decimal(38,0)")
    base = np.array([s // n for s in sums.tolist()], np.int64)
    rest = np.array([s - n * b for s, b in zip(sums.tolist(), base.tolist(), strict=True)], object)

    def products(x: np.ndarray) -> np.ndarray:
        return _exact(x - base, x - base)

    gram = _summed(fit, width, (width, width), products, "decimal(38,0)")
    scaled = n * gram - np.outer(rest, rest)  # n^2 times the covariance, exactly
    covariance = np.array([[int(v) / n**2 for v in row] for row in scaled.tolist()])
    values, basis = leading_pairs(covariance, components)
    found = Whitening(n, base, rest, values, basis / np.sqrt(values), float(np.trace(covariance)), 0.0)
    k = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        z = found.project(x)
        return np.vstack([z.T @ z, z.sum(axis=0)])

    seen = _summed(fit, width, (k + 1, k), moments, "double") / n if k else np.zeros((1, 0))
    error = np.abs(seen[:-1] - np.outer(seen[-1], seen[-1]) - np.eye(k)).max(initial=0.0)
    return found._replace(identity_error=float(error))


def whitened(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each vector of ``df`` and leading component of all its distinct vectors.

    ``deviation`` is the exact sum over dimensions of (n x - S)^2, null where it passes 64 bits.
    ``lattice`` says which rows count; of those only vectors of the commonest length do (of equally
    common ones, the longest). Components whose eigenvalue is zero but for rounding have no rows:
    one distinct vector or none gives an empty result. Repeated rows, repeated and null ids each
    give their rows; other columns are not read.
    """
    rows = lattice(df, id_col, vector_col)
    lengths = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    spark = df.sparkSession
    if lengths is None:
        return spark.createDataFrame([], _RESULT)
    width = lengths["width"]
    rows = rows.where(F.size("x") == width)
    model = fit_whitening(rows, width, components)
    n, k = model.n, len(model.values)
    explained = model.values / model.trace if k else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows if k else 0, BATCH):
                batch = whole.slice(at, BATCH)
                x = _vectors(batch, 1, width)
                off = x - model.base
                near = n * (int(np.abs(off).max(initial=0)) + 1) < 2**28 and width < 2**6
                scaled = off * n - model.rest.astype(np.int64) if near else off.astype(object) * n - model.rest
                deviation = [int(v) if v < 2**63 else None for v in (scaled * scaled).sum(axis=1).tolist()]
                out = [
                    batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, n, np.int64)),
                    pa.array([v for v in deviation for _ in range(k)], pa.int64()),
                    pa.array(model.project(x).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(x) * k, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(out, [c.split()[0] for c in _RESULT.split(", ")])

    return rows.mapInArrow(run, _RESULT)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
