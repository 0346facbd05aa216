"""Whitening of vectors by their leading principal components.

Entries become whole numbers, floor(scale * c).  The fit list, each distinct vector once, is a written table; its size and exact sums,
then its centred covariance are added up in tasks and merged by aggregations whose rows are pairs of dimensions, never
vectors.  The driver holds that matrix alone (dimensions squared, whatever the number of rows): Householder reflections
make it tridiagonal, bisection with Sturm counts gives the leading eigenvalues, inverse iteration with
reorthogonalisation inside clusters their vectors.  The projection is broadcast.

Defined results: rows whose vector is null, holds null or non-finite entries, or has another length than most vectors (of
equals the longest; the empty one included) are dropped; rows are never merged, so repeated rows give repeated results.  Of d < components dimensions
there are d components.  A component without variance (at most 1e-12 of the whole) has null coordinates and is left out of
identity_error.  `deviation` is null where it does not fit a long.  Entries beyond 2^52 are no longer exact as a
double holds them.  Without rows the result is empty.  A result column whose name is taken gets `_` put behind its name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from .text import unused, written

SCALE, COMPONENTS = 256, 4
FLAT = 1e-12


@dataclass
class Whitening:
    """What a fit gives: all are of the size of the dimensions."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray  # leading eigenvalues, falling
    vectors: np.ndarray  # (components, dimensions), unit rows
    identity_error: float | None = None

    @property
    def real(self) -> np.ndarray:
        return self.values > FLAT * self.trace

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        """(rows, components); NaN for components without variance."""
        mean = np.array([s / self.n for s in self.sums])
        with np.errstate(divide="ignore", invalid="ignore"):
            scaled = (x - mean) @ self.vectors.T / np.sqrt(np.where(self.real, self.values, np.nan))
        return scaled

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum of (n * x - S)^2, exact: in 64 bits where they surely do, else in whole numbers of any size."""
        largest = max([abs(int(v)) for v in (x.max(initial=0), x.min(initial=0))] + [0]) * self.n + max([abs(s) for s in self.sums] + [0])
        if largest * largest * max(1, x.shape[1]) < 2**63:
            d = self.n * x - np.array(self.sums, np.int64)
            return pa.array((d * d).sum(axis=1))
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return pa.array([v if v < 2**63 else None for v in exact], pa.int64())


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflections (unit vectors u, each of I - 2 u u^T, in order) of a symmetric matrix."""
    a = a.copy()
    d = len(a)
    turns = []
    for k in range(d - 2):
        u = a[k + 1 :, k].copy()
        size = np.linalg.norm(u)
        if size:
            u[0] += np.copysign(size, u[0])
            u /= np.linalg.norm(u)
            block = a[k + 1 :, k + 1 :]
            p = block @ u
            q = p - (u @ p) * u
            block -= 2 * np.outer(u, q) + 2 * np.outer(q, u)
            a[k + 1 :, k] -= 2 * u * (u @ a[k + 1 :, k])
        turns.append(u)
    return np.diag(a).copy(), np.array([a[k + 1, k] for k in range(d - 1)]), turns


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix lie below each of `at`."""
    least = np.finfo(float).tiny / np.finfo(float).eps
    count, q = np.zeros(len(at), np.int64), np.ones(len(at))
    for k in range(len(diagonal)):
        q = diagonal[k] - at - (off[k - 1] ** 2 / q if k else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, m: int) -> np.ndarray:
    """The m largest eigenvalues, falling, each to the last bits by bisection; all are bisected side by side."""
    wide = np.abs(np.append(off, 0.0)) + np.abs(np.append(0.0, off))
    low, high = np.full(m, (diagonal - wide).min()), np.full(m, (diagonal + wide).max())
    slack = 4 * np.finfo(float).eps * max(np.abs(low[0]), np.abs(high[0])) + np.finfo(float).tiny
    low, high = low - slack, high + slack
    rank = len(diagonal) - 1 - np.arange(m)  # eigenvalues below the wanted one
    for _ in range(200):
        mid = (low + high) / 2
        if not ((mid > low) & (mid < high)).any():
            break
        under = below(diagonal, off, mid) <= rank
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def _solved(diagonal: np.ndarray, off: np.ndarray, value: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solution of (T - value) z = right by elimination with row exchanges; a pivot of nought becomes `least`."""
    n = len(diagonal)
    a, b, c, z = (diagonal - value).tolist(), [*off.tolist(), 0.0], [0.0] * n, right.tolist()
    for k in range(n - 1):
        under = off[k]
        if abs(under) > abs(a[k]):  # rows k and k + 1 change places
            f = a[k] / under
            a[k], a[k + 1], b[k], b[k + 1], c[k] = under, b[k] - f * a[k + 1], a[k + 1], -f * b[k + 1], b[k + 1]
            z[k], z[k + 1] = z[k + 1], z[k] - f * z[k + 1]
        else:
            a[k] = a[k] if abs(a[k]) > least else least
            f = under / a[k]
            a[k + 1] -= f * b[k]
            z[k + 1] -= f * z[k]
    a[-1] = a[-1] if abs(a[-1]) > least else least
    for k in range(n - 1, -1, -1):
        rest = z[k] - (b[k] * z[k + 1] if k + 1 < n else 0.0) - (c[k] * z[k + 2] if k + 2 < n else 0.0)
        z[k] = rest / a[k]
        if abs(z[k]) > 1e200:
            z[k:] = [v / 1e200 for v in z[k:]]
            z[:k] = [v / 1e200 for v in z[:k]]
    return np.array(z)


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors as rows, by inverse iteration; those of a cluster of values are kept orthogonal."""
    size = max(np.abs(diagonal).max(initial=0), np.abs(off).max(initial=0), np.finfo(float).tiny)
    least = np.finfo(float).eps * size
    rng, out = np.random.default_rng(13), []
    for k, value in enumerate(values):
        near = [out[j] for j in range(k) if abs(values[j] - value) < 1e-3 * size]
        z = rng.standard_normal(len(diagonal))
        for _ in range(6):
            z = _solved(diagonal, off, value, z / np.linalg.norm(z), least)
            z /= np.abs(z).max()
            for _ in range(2):
                for other in near:
                    z -= (other @ z) * other
            z /= np.linalg.norm(z)
        out.append(z)
    return np.array(out)


def leading_components(v: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The m leading eigenvalues and unit eigenvectors (rows, largest entry positive) of a symmetric matrix."""
    m = min(m, len(v))
    if not m or not v.any():
        return np.zeros(m), np.eye(len(v))[:m]
    diagonal, off, turns = tridiagonal(v)
    values = leading_values(diagonal, off, m)
    z = leading_vectors(diagonal, off, values)
    for k in range(len(turns) - 1, -1, -1):
        part = z[:, k + 1 :]
        part -= 2 * np.outer(part @ turns[k], turns[k])
    top = z[np.arange(m), np.abs(z).argmax(axis=1)]
    return values, z * np.sign(top)[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, len(flat) // n if n else 0)


def _added(frame: DataFrame, per: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of per(matrix of a batch) over all rows: tasks add up, then one row for each place of the result is aggregated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = per(_matrix(batch.column(0)))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int64)), pa.array(total)], names=["i", "v"])

    kind = "decimal(38,0)" if per is _halves else "double"
    rows = frame.mapInArrow(run, "i long, v " + ("long" if per is _halves else "double")).groupBy("i").agg(F.sum(F.col("v").cast(kind)).alias("v")).orderBy("i").collect()
    return np.array([int(r.v) if per is _halves else r.v for r in rows], object if per is _halves else float)


def _halves(x: np.ndarray) -> np.ndarray:
    """Row count, then sums of the upper and of the lower 32 bits of each dimension: whole numbers that cannot overflow in a task."""
    return np.concatenate([[len(x)], (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])


def whole_vectors(df: DataFrame, vector: str, name: str, scale: int = SCALE) -> DataFrame:
    """df with `name`, array<long> of floor(scale * c), of the rows whose vector can be used."""
    size = F.size(f"`{vector}`")
    finite = F.forall(f"`{vector}`", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    good = df.where(F.col(f"`{vector}`").isNotNull() & finite)
    per = good.groupBy(size.alias("d")).agg(F.count("*").alias("m")).agg(F.max(F.struct("m", "d")).alias("top")).first().top
    rows = good.where(size == (per.d if per is not None else -1))
    return rows.withColumn(name, F.transform(f"`{vector}`", lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))))


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of a DataFrame (x array<long>, all of one length); vectors count once."""
    listed = written(x.select("x").distinct())
    sums = _added(listed, _halves)
    if not len(sums):
        return Whitening(0, [], 0.0, np.zeros(0), np.zeros((0, 0)))
    n, d = int(sums[0]), len(sums) // 2
    whole = [(int(a) << 32) + int(b) for a, b in zip(sums[1 : d + 1], sums[d + 1 :])]
    if not d:
        return Whitening(n, [], 0.0, np.zeros(0), np.zeros((0, 0)))
    mean, upper = np.array([s / n for s in whole]), np.triu_indices(d)

    def products(part: np.ndarray) -> np.ndarray:
        centred = part - mean
        return (centred.T @ centred)[upper]

    v = np.zeros((d, d))
    v[upper] = _added(listed, products) / n
    v += np.triu(v, 1).T
    out = Whitening(n, whole, float(np.trace(v)), *leading_components(v, components))
    if out.real.any():
        def whitened(part: np.ndarray) -> np.ndarray:
            w = out.coordinates(part)[:, out.real]
            return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

        m = int(out.real.sum())
        total = _added(listed, whitened) / n
        out.identity_error = float(np.abs(total[m:].reshape(m, m) - np.outer(total[:m], total[:m]) - np.eye(m)).max())
    return out


def whitened(df: DataFrame, *, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> tuple[DataFrame, Whitening]:
    """The rows of df that can be used, with `deviation` long and `whitened` array<double>, and the fit."""
    own, deviation, coordinates = unused(["x", "deviation", "whitened"], df.columns)
    rows = whole_vectors(df, vector, own, scale)
    model = fit(rows.select(F.col(f"`{own}`").alias("x")), components)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*df.schema.fields]).add(deviation, LongType()).add(coordinates, ArrayType(DoubleType()))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(batch.num_columns - 1))
            w = shared.value.coordinates(x)
            flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], shared.value.deviations(x), lists], names=schema.names)

    return rows.mapInArrow(project, schema), model


def whitening_digest(embeddings: DataFrame) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows, model = whitened(embeddings.select("vec_id", "embedding"))
    shares = F.array(*[F.lit(float(v / model.trace) if model.trace else None).cast("double") for v in model.values]).cast("array<double>")
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return each.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("k")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
