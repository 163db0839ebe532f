"""Embedding whitening: a distributed centred covariance, leading eigenpairs by bisection and inverse iteration, a broadcast projection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, slices

COMPONENTS = 32
#: Fixed point of the contract: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
EPS = float(np.finfo(np.float64).eps)
#: Entries in fixed point end here, so that differences of two stay in 64 bits.
EDGE = 1 << 61
#: Groups of tasks whose matrices are added up first.
GROUPS = 32
#: Eigenvalues closer than this part of the norm form a cluster, whose vectors are made orthogonal to each other.
CLUSTER = 1e-3


def householder(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of a tridiagonal matrix similar to the symmetric ``a``, and the unit reflectors in order."""
    a, d = np.array(a, np.float64), len(a)
    reflectors = []
    for k in range(d - 2):
        x = a[k + 1 :, k]
        scale = np.abs(x).max()
        v = np.zeros(len(x))
        if np.abs(x[1:]).max() > 0:
            v = x / scale
            v[0] += np.copysign(np.linalg.norm(v), v[0])
            v /= np.linalg.norm(v)
            block = a[k + 1 :, k + 1 :]
            p = block @ v
            q = p - (v @ p) * v
            block -= 2 * (np.outer(v, q) + np.outer(q, v))
            x -= 2 * v * (v @ x)
            a[k, k + 1 :] = x
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm count: eigenvalues of the tridiagonal matrix below each number in ``at``."""
    tiny = EPS * max(float(np.abs(off).max(initial=0)), float(np.abs(diagonal).max(initial=0)), np.finfo(np.float64).tiny) ** 2 + np.finfo(np.float64).tiny
    count, q = np.zeros(len(at), np.int64), np.ones(len(at))
    for i in range(len(diagonal)):
        q = diagonal[i] - at - ((off[i - 1] ** 2 / q) if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection of the Sturm count until the bounds are neighbours."""
    d = len(diagonal)
    reach = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    lo = np.full(k, (diagonal - reach).min())
    hi = np.full(k, (diagonal + reach).max())
    margin = 2 * EPS * d * max(np.abs(lo).max(), np.abs(hi).max()) + np.finfo(np.float64).tiny
    lo, hi = lo - margin, hi + margin
    wanted = d - np.arange(k)  # the i-th largest has d - i eigenvalues up to it
    for _ in range(2000):
        middle = (lo + hi) / 2
        if not ((middle > lo) & (middle < hi)).any():
            break
        over = below(diagonal, off, middle) >= wanted
        hi, lo = np.where(over, middle, hi), np.where(over, lo, middle)
    return (lo + hi) / 2


def factored(diagonal: np.ndarray, off: np.ndarray, shift: float, least: float) -> tuple:
    """Elimination with row exchanges of (T - shift I): pivots, two upper diagonals, multipliers, exchanges."""
    d = len(diagonal)
    u0, u1, u2 = np.zeros(d), np.zeros(d), np.zeros(d)
    factor, swapped = np.zeros(d), np.zeros(d, bool)
    a, b = diagonal[0] - shift, off[0] if d > 1 else 0.0
    for i in range(d - 1):
        below_a, below_b, below_c = off[i], diagonal[i + 1] - shift, off[i + 1] if i + 2 < d else 0.0
        if abs(below_a) > abs(a):
            swapped[i] = True
            u0[i], u1[i], u2[i] = below_a, below_b, below_c
            factor[i] = a / below_a
            a, b = b - factor[i] * below_b, -factor[i] * below_c
        else:
            u0[i], u1[i] = a if abs(a) > least else least, b
            factor[i] = below_a / u0[i]
            a, b = below_b - factor[i] * b, below_c
    u0[d - 1] = a if abs(a) > least else least
    return u0, u1, u2, factor, swapped


def solved(factors: tuple, y: np.ndarray) -> np.ndarray:
    u0, u1, u2, factor, swapped = factors
    y, d = y.tolist(), len(y)
    for i in range(d - 1):
        if swapped[i]:
            y[i], y[i + 1] = y[i + 1], y[i] - factor[i] * y[i + 1]
        else:
            y[i + 1] -= factor[i] * y[i]
    for i in range(d - 1, -1, -1):
        y[i] = (y[i] - (u1[i] * y[i + 1] if i + 1 < d else 0.0) - (u2[i] * y[i + 2] if i + 2 < d else 0.0)) / u0[i]
    return np.array(y)


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of falling eigenvalues; those of a cluster are made orthogonal in every round."""
    d, rng = len(diagonal), np.random.default_rng(0)
    norm = max(float((np.abs(diagonal) + np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])).max()), np.finfo(np.float64).tiny)
    least = EPS * norm
    vectors = np.zeros((d, len(values)))
    first, shift = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            first = k
        # equal eigenvalues get shifts that differ a little
        shift = min(float(value), shift - 10 * least) if k > first else float(value)
        factors = factored(diagonal, off, shift, least)
        cluster = vectors[:, first:k]

        def across(x: np.ndarray, cluster: np.ndarray = cluster) -> np.ndarray:
            for _ in range(2):
                x = x - cluster @ (cluster.T @ x)
            return x

        x = across(rng.standard_normal(d))
        x /= np.linalg.norm(x)
        good = 0
        for _ in range(12):
            y = solved(factors, x)
            y /= np.abs(y).max()
            y = across(y)
            y /= np.linalg.norm(y)
            # one more round once it stands still
            good = good + 1 if min(np.linalg.norm(y - x), np.linalg.norm(y + x)) < 1e-10 else 0
            x = y
            if good > 1:
                break
        vectors[:, k] = x
    return vectors


def leading_eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    scale = float(np.abs(matrix).max(initial=0))
    if not scale:
        return np.zeros(k), np.eye(len(matrix), k)
    diagonal, off, reflectors = householder(matrix / scale)
    values = leading_values(diagonal, off, k)
    vectors = inverse_iteration(diagonal, off, values)
    for i, v in reversed([*enumerate(reflectors)]):
        vectors[i + 1 :] -= 2 * np.outer(v, v @ vectors[i + 1 :])
    # one orthogonalisation of all, so that vectors of separate clusters are orthogonal to rounding as well
    for j in range(k):
        for _ in range(2):
            vectors[:, j] -= vectors[:, :j] @ (vectors[:, :j].T @ vectors[:, j])
        vectors[:, j] /= np.linalg.norm(vectors[:, j])
    return values * scale, vectors


def fitting(df: DataFrame, vector: str, dimensions: int | None = None) -> Column:
    """The rows to keep: a vector without null or non-finite entries, of the table's dimensions."""
    entry = F.col(vector)
    whole = entry.isNotNull() & (F.size(entry) > 0) & F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(whole if dimensions is None else whole & (F.size(entry) == dimensions), F.lit(False))


def matrix_of(column: pa.Array, dimensions: int) -> np.ndarray:
    """Fixed-point entries of a column of vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.clip(np.floor(SCALE * flat), -EDGE, EDGE).astype(np.int64) + SHIFT).reshape(-1, dimensions)


def decimal_of(x: int) -> Decimal | None:
    return Decimal(x) if x < 10**38 else None


@dataclass
class Whitening:
    """What was fitted: ``n`` vectors with sums ``sums``, falling eigenvalues and their vectors (columns), all of one dimension."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def whole(self) -> np.ndarray:
        """Floor of the mean: an integer close to all of them, taken off exactly."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def part(self) -> np.ndarray:
        """What is left of the mean, at least 0 and less than 1."""
        return np.array([s % self.n / self.n for s in self.sums])

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def sums(kept: DataFrame, vector: str) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension, added up by each task before they are shuffled."""

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for part in slices(parts, 4096):
            column = part.column(0)
            if len(column):
                x = matrix_of(column, len(column[0]))
                n += len(x)
                # in two parts, so that no number of rows overflows
                both = np.stack([(x >> 20).sum(0), (x & 0xFFFFF).sum(0)])
                total = both if total is None else total + both
        if n:
            d = total.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(total[0]), pa.array(total[1])], names=["i", "n", "high", "low"])

    part = kept.select(vector).mapInArrow(add, "i long, n long, high long, low long")
    # as many rows as there are dimensions
    rows = part.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).orderBy("i").collect()
    return (int(rows[0].n), [(int(r.high) << 20) + int(r.low) for r in rows]) if rows else (0, [])


def covariance(kept: DataFrame, vector: str, n: int, center: Callable, width: int) -> np.ndarray:
    """Covariance (divisor ``n``) of the ``width`` columns that ``center`` makes of a batch of vectors, centred.

    Each task adds up one matrix, the tasks of a group theirs, and one task those of the groups: ``width`` rows whatever the table,
    which go to the driver.
    """

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for part in slices(parts, 4096):
            if part.num_rows:
                z = center(part.column(0))
                total += z.T @ z
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array([x.tobytes() for x in total], pa.binary())], names=["i", "entries"])

    def join(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for part in parts:
            for i, entries in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                total[i] = total.get(i, 0.0) + np.frombuffer(entries)
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["i", "entries"])

    schema = "i long, entries binary"
    # a tree of two levels: groups of tasks first, then all
    dealt = kept.select(vector).mapInArrow(add, schema).withColumn("g", F.spark_partition_id() % GROUPS)
    mid = dealt.repartition(GROUPS, "g").select("i", "entries").mapInArrow(join, schema)
    rows = mid.repartition(1).mapInArrow(join, schema).collect()
    out = np.zeros((width, width))
    for r in rows:
        out[r.i] = np.frombuffer(r.entries)
    return (out + out.T) / 2 / n


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fit on every kept vector of ``df``; None if there is none.

    Components whose eigenvalue is zero within rounding have no whitened values and are left out.
    """
    longest = df.filter(fitting(df, vector)).agg(F.max(F.size(vector)).alias("d")).first().d
    if longest is None:
        return None
    kept = df.filter(fitting(df, vector, longest))
    n, total = sums(kept, vector)
    done = Whitening(n, total, 0.0, np.zeros(0), np.zeros((longest, 0)))
    whole, part, d = done.whole, done.part, longest
    v = covariance(kept, vector, n, lambda column: (matrix_of(column, d) - whole) - part, d)
    trace = float(np.trace(v))
    values, vectors = leading_eigenpairs(v, min(components, d))
    live = values > max(trace, 0.0) * d * EPS * 16
    return Whitening(n, total, trace, values[live], vectors[:, live])


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row of each kept vector: key, n, deviation (decimal, exact), whitened and explained (arrays by component), identity_error.

    Vectors that are null, or hold null or non-finite entries, are left out of fit and result; so are empty ones and those with fewer
    entries than the longest kept one, which lack entries. Repeated rows count and come back as often as they are. Equal
    eigenvalues are numbered in any order. Components without variance are left out; if all vectors are equal the arrays are empty and the
    error is 0. An empty table gives an empty result. Broadcast: one matrix of dimensions x components.

    Entries are taken as floor(SCALE * c) + SHIFT, with floor(SCALE * c) ended at EDGE on both sides; the integer part of the mean is taken off
    exactly, so no digits are lost to SHIFT. A deviation of more than 38 digits is null.
    """
    model = fit(df, vector, components)
    schema = f"{key} {df.schema[key].dataType.simpleString()}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    n, d, k = model.n, len(model.sums), len(model.values)
    whole, part, projection = model.whole, model.part, model.projection
    rest = np.array([s % n for s in model.sums], object)
    explained = (model.values / model.trace).tolist() if k else []
    kept = df.filter(fitting(df, vector, d))
    error = float(np.abs(covariance(kept, vector, n, lambda column: ((matrix_of(column, d) - whole) - part) @ projection, k) - np.eye(k)).max()) if k else 0.0

    def project(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(parts, 4096):
            if not b.num_rows:
                continue
            y = matrix_of(b.column(1), d) - whole
            w = (y - part) @ projection
            m = len(y)
            if n * (float(np.abs(y).max()) + 1) < 2**31 / d**0.5:
                deviation = ((n * y - rest.astype(np.int64)) ** 2).sum(1).tolist()
            else:
                deviation = [sum(x * x for x in row) for row in (n * y.astype(object) - rest).tolist()]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * k, pa.int32()), pa.array(w.ravel()))
            same = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * k, pa.int32()), pa.array(np.tile(explained, m), pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(m, n)), pa.array(map(decimal_of, deviation), pa.decimal128(38, 0)), lists, same, pa.array(np.full(m, error))], names=[key, "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.select(key, vector).mapInArrow(project, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of each vector and component; a deviation that a long can't hold is null here, ``whiten`` has it as a decimal."""
    rows = whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = rows.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("_at", "_pair"))
    return each.select("vec_id", (F.col("_at") + 1).cast("int").alias("component"), "n", "deviation", F.col("_pair.whitened").alias("whitened"), F.col("_pair.explained").alias("explained"), "identity_error")
