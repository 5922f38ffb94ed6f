"""Whitening of embeddings by principal components.

Entries are taken as whole numbers x = floor(1024 c) + 100000. One pass sums them exactly, a second sums the products
of entries centred before they are multiplied, each task one matrix of its own. The covariance, dimensions x dimensions
whatever the rows, is decomposed on the driver: Householder reflections bring it to tridiagonal form, Sturm counts
bisect the leading eigenvalues, inverse iteration finds their vectors, made orthogonal again within clusters of close
eigenvalues. The components, as many numbers as dimensions for each, go to all tasks, which project their rows.

A row passes three times from its table to a task and is never shuffled; memory is a matrix a task and a batch of rows.

Defined cases: vectors that are null or hold null or non-finite entries take no part, nor do those with an entry too
large for a long, nor those of another length than most have (of equal counts the longer; empty ones never count);
null and repeated ids have rows like any other; fewer dimensions than asked for give as many components; a component
whose eigenvalue is zero to rounding (one vector, constant dimensions) has whitened null and explained 0 and does not
count for identity_error; a deviation beyond a long is null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import stage, workers_import_us

COMPONENTS, SCALE, SHIFT = 8, 1024, 100000
#: Entries of a batch that are worked on at once.
NUMBERS = 1 << 20
_EPS = np.finfo(float).eps
_SMALL = 2**62
_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal d, off-diagonal e and reflectors v of a symmetric matrix: a = Q T Q' with Q = H0 H1 ..., Hk = I - 2 vk vk'."""
    a, m = a.copy(), len(a)
    reflectors = np.zeros((max(m - 2, 0), m))
    for k in range(m - 2):
        x = a[k + 1 :, k].copy()
        size = np.sqrt(x @ x)
        if not size or not x[1:].any():
            continue
        v = x.copy()
        v[0] += np.copysign(size, x[0])
        v /= np.sqrt(v @ v)
        reflectors[k, k + 1 :] = v
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        p -= (v @ p) * v
        rest -= 2 * (np.outer(v, p) + np.outer(p, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(size, x[0])
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def counts_below(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix lie below each of at."""
    least = max(np.abs(d).max(initial=0), np.abs(e).max(initial=0)) * _EPS**2
    pivot, below = np.ones(len(at)), np.zeros(len(at), int)
    for i in range(len(d)):
        pivot = d[i] - at - (e[i - 1] ** 2 / pivot if i else 0)
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        below += pivot < 0
    return below


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection down to neighbouring doubles or the rounding of the matrix."""
    reach = np.abs(np.append(e, 0)) + np.abs(np.insert(e, 0, 0))
    low, high = np.full(k, (d - reach).min()), np.full(k, (d + reach).max())
    size = max(abs(low[0]), abs(high[0]))
    low, high = low - 4 * _EPS * size, high + 4 * _EPS * size
    most = len(d) - np.arange(k)  # the j-th largest has fewer than m - j eigenvalues below it
    for _ in range(200):
        middle = (low + high) / 2
        if np.all((high - low <= _EPS * _EPS * size) | (middle <= low) | (middle >= high)):
            break
        above = counts_below(d, e, middle) >= most
        low, high = np.where(above, low, middle), np.where(above, middle, high)
    return (low + high) / 2


def _solve(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """(T - shift I) z = b by elimination with row exchanges; pivots of nothing count as least."""
    m = len(d)
    main, upper, second, z = d - shift, np.append(e, 0.0), np.zeros(m), b.copy()
    for i in range(m - 1):
        if abs(e[i]) > abs(main[i]):
            factor = main[i] / e[i]
            main[i], upper[i], second[i], main[i + 1], upper[i + 1] = e[i], main[i + 1], upper[i + 1], upper[i] - factor * main[i + 1], -factor * upper[i + 1]
            z[i], z[i + 1] = z[i + 1], z[i] - factor * z[i + 1]
        else:
            factor = e[i] / main[i] if main[i] else 0.0
            main[i + 1] -= factor * upper[i]
            z[i + 1] -= factor * z[i]
    main = np.where(np.abs(main) < least, least, main)
    for i in range(m - 1, -1, -1):
        z[i] = (z[i] - (upper[i] * z[i + 1] if i + 1 < m else 0) - (second[i] * z[i + 2] if i + 2 < m else 0)) / main[i]
        if abs(z[i]) > 1e200:
            z /= abs(z[i])
    return z


def eigenvectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit eigenvector (a row each) for each of values, by inverse iteration."""
    size = np.abs(d).max(initial=0) + 2 * np.abs(e).max(initial=0)
    random, found = np.random.default_rng(0), np.zeros((len(values), len(d)))
    cluster = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * size:
            cluster = j
        others, z = found[cluster:j], random.standard_normal(len(d))
        for _ in range(6):
            z = _solve(d, e, value, z / np.sqrt(z @ z), _EPS * size)
            for _ in range(2):  # twice, as once leaves rounding
                z -= others.T @ (others @ z)
            z /= np.abs(z).max() or 1
            if not z.any():
                z = random.standard_normal(len(d))
        found[j] = z / np.sqrt(z @ z)
    return found


def components(covariance: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows."""
    size = np.abs(covariance).max(initial=0)
    if not size:
        return np.zeros(min(k, len(covariance))), np.eye(len(covariance))[:k]
    d, e, reflectors = tridiagonal(covariance / size)
    values = leading_eigenvalues(d, e, min(k, len(d)))
    vectors = eigenvectors(d, e, values)
    for v in reflectors[::-1]:
        vectors -= 2 * np.outer(vectors @ v, v)
    return values * size, vectors


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of the rows that take part, v as doubles, and their length."""
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(_SMALL // SCALE))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", fits))
    most = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = most["dims"] if most else 0
    return rows.filter(F.size("v") == dims), dims


def _numbers(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """ids and x of a bounded number of rows at a time."""
    step = max(1, NUMBERS // max(dims, 1))
    for batch in batches:
        for at in range(0, len(batch), step):
            part = batch.slice(at, step)
            yield part.column(0), np.floor(SCALE * part.column(1).flatten().to_numpy().reshape(-1, dims)).astype(np.int64) + SHIFT


def _exact(x: np.ndarray, factor: int) -> np.ndarray:
    """x as longs if factor times its entries, and sums of as many, fit; else as whole numbers of any size."""
    return x if int(np.abs(x).max(initial=0)) * factor < _SMALL else x.astype(object)


def _sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """n and the sum of each dimension: one row a task and dimension, added as decimals."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        for ids, x in _numbers(batches, dims):
            n += len(ids)
            total = total + _exact(x, len(ids)).sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims), pa.array([str(t) for t in total])], ["dim", "n", "total"])

    found = rows.select("vec_id", "v").mapInArrow(add, "dim int, n long, total string")
    found = found.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("dim").collect()
    return found[0]["n"], [int(r["total"]) for r in found]


def _centred(x: np.ndarray, n: int, total: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n x - S, exact, and x - S / n."""
    most = max(map(abs, total), default=0)
    exact = _exact(x, 2 * n) if most < _SMALL else x.astype(object)
    away = n * exact - np.array(total, exact.dtype)
    return away, (away / n).astype(float)


def _covariance(rows: DataFrame, dims: int, n: int, total: list[int]) -> np.ndarray:
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = np.zeros((dims, dims))
        seen = False
        for _, x in _numbers(batches, dims):
            y, seen = _centred(x, n, total)[1], True
            products += y.T @ y
        if seen:
            for i in range(dims):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(dims - i, i, np.int32)), pa.array(np.arange(i, dims, dtype=np.int32)), pa.array(products[i, i:])], ["i", "j", "p"])

    found = rows.select("vec_id", "v").mapInArrow(multiply, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p")).collect()
    v = np.zeros((dims, dims))
    for i, j, p in found:
        v[i, j] = v[j, i] = p / n
    return v


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row that takes part and each of k components.

    x - S/n projected on the component, over the square root of its eigenvalue; explained is that eigenvalue's share of the
    trace; identity_error is the largest entry by which the covariance of whitened differs from the identity.
    """
    spark = vectors.sparkSession
    workers_import_us(spark)
    rows, dims = _usable(vectors, id_col, vector_col)
    if not dims:
        return spark.createDataFrame([], _SCHEMA)
    n, total = _sums(rows, dims)
    covariance = _covariance(rows, dims, n, total)
    trace = float(np.trace(covariance))
    values, axes = components(covariance, k)
    some = values > dims * _EPS * max(trace, 0) * 4
    explained = np.where(some, values / trace if trace > 0 else 0.0, 0.0)
    projection = np.where(some[:, None], axes / np.sqrt(np.where(some, values, 1))[:, None], 0).T

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _numbers(batches, dims):
            away, y = _centred(x, n, total)
            if int(np.abs(away).max(initial=0)) ** 2 * dims >= _SMALL:
                away = away.astype(object)
            deviation = pa.array([int(a) if a < 2**63 else None for a in (away * away).sum(axis=1)], pa.int64())
            white = pa.FixedSizeListArray.from_arrays(pa.array((y @ projection).ravel()), len(values)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([ids, deviation, white], ["vec_id", "deviation", "white"])

    white = stage(rows.mapInArrow(project, "vec_id long, deviation long, white array<double>"), "whitened")
    pairs = list(combinations_with_replacement(np.flatnonzero(some).tolist(), 2))
    error = None
    if pairs:
        covariances = white.agg(*[F.covar_pop(F.col("white")[i], F.col("white")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
        error = max(abs(c - (i == j)) for c, (i, j) in zip(covariances, pairs, strict=True))
    each = F.posexplode(F.arrays_zip(F.col("white").alias("white"), F.array(*map(F.lit, explained.tolist())).alias("explained"), F.array(*map(F.lit, some.tolist())).alias("some")))
    out = white.select("vec_id", "deviation", each.alias("at", "c"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(F.col("c.some"), F.col("c.white")).alias("whitened"),
        F.col("c.explained").alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
