"""Whitening of embeddings by the singular vectors of their centred rows.

A vector's entries c become integers x = floor(1024 * c) + 100000, so that sums, means and deviations are exact. The
components are right singular vectors of the matrix of rows x - S / n, from MLlib's computeSVD; a singular value s stands
for the eigenvalue s * s / n of the covariance with divisor n. The trace of that covariance is not taken from the singular
values, of which only the first are known, but from the rows' exact deviations.

Four passes over the vectors: sums, deviations, the singular value decomposition, projections; and two over the
projections, for the covariance that the result really has. The driver holds what grows with the dimensions alone: their
sums, and up to DENSE dimensions a square matrix of them. Beyond DENSE dimensions MLlib multiplies by the rows again and
again, without a matrix, to 10 digits of an eigenvalue instead of all.

Vectors that are null or hold null, non-finite or entries of 2**43 or more (whose x is not exact in double precision) take
no part. A shorter vector counts as if it ended in zeros. Repeated rows count repeatedly, and a null key is a key. Without
vectors, or if all are equal, there is no component and no row; components whose eigenvalue is below 1e-11 of the largest
count as none. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import dropped, small_batches, stored

#: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries from here on are not exact as x.
LARGEST = float(1 << 43)
#: Dimensions up to which MLlib solves for all components of one square matrix.
DENSE = 1024
#: The smallest singular value that counts, as a share of the largest.
LEAST_SHARE = 1e-11**0.5
#: Integers of more digits have no place in a decimal column.
MOST_DECIMAL = 10**38


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column's slice."""
    at = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0]


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length in a list column: the places of its rows, and the rows as a matrix."""
    values, at = _rows(column)
    sizes = np.diff(at)
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        yield own, values[at[own][:, None] + np.arange(size)] if size else np.zeros((len(own), 0), values.dtype)


def integers(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x array<bigint>) of the rows that take part."""
    c = F.transform(F.col(vector), lambda e: e.cast("double"))
    fit = F.forall(c, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < LARGEST), F.lit(False)))
    x = F.transform(c, lambda e: (F.floor(e * SCALE) + SHIFT).cast("bigint"))
    return embeddings.where(F.col(vector).isNotNull() & fit).select(F.col(key).alias("key"), x.alias("x"))


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """How many rows there are, and each dimension's exact sum. A task sends one row for each dimension, with the number of its
    rows that have it, and one (-1) for the number of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, seen = 0, np.zeros(0, object), np.zeros(0, np.int64)
        for b in batches:
            n += len(b)
            for own, x in _by_length(b.column(0)):
                more = x.shape[1] - len(total)
                if more > 0:
                    total, seen = np.append(total, [0] * more), np.append(seen, np.zeros(more, np.int64))
                # halves of 32 bits, whose sums over a batch cannot overflow
                total[: x.shape[1]] += (x >> 32).sum(0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
                seen[: x.shape[1]] += len(own)
        if n:
            sums = [Decimal(0), *[Decimal(int(t)) for t in total]]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array([n, *seen.tolist()], pa.int64()), pa.array(sums, pa.decimal128(38, 0))], names=["i", "n", "s"])

    found = rows.select("x").mapInArrow(run, "i int, n bigint, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    by_dim = {r.i: (r.n, int(r.s)) for r in found}
    n = by_dim.pop(-1, (0, 0))[0]
    # what a shorter row lacks counts as zero, whose x is the shift
    return n, [by_dim[i][1] + (n - by_dim[i][0]) * SHIFT for i in range(len(by_dim))]


def _filled(x: np.ndarray, dims: int) -> np.ndarray:
    return x if x.shape[1] == dims else np.pad(x, ((0, 0), (0, dims - x.shape[1])), constant_values=SHIFT)


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Each dimension's mean as a whole part and the rest times n, both exact."""
    return np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)


def _exact_deviations(x: np.ndarray, n: int, whole: np.ndarray, rest: np.ndarray) -> list[int]:
    """The sum of (n * x - S) ** 2 of each row, in 64 bits where that is enough."""
    near = x - whole
    most = max(abs(int(near.min(initial=0))), abs(int(near.max(initial=0)))) * n + n
    if most * most * max(1, x.shape[1]) < 1 << 63:
        d = near * n - rest
        return np.einsum("ij,ij->i", d, d).tolist()
    return (((near.astype(object) * n - rest.astype(object)) ** 2).sum(1)).tolist() if x.shape[1] else [0] * len(x)


def _each(rows: DataFrame, dims: int, schema: str, make: Callable[[np.ndarray], list[pa.Array]], names: list[str]) -> DataFrame:
    """Columns that `make` gives for a matrix of x, beside the key."""
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, x in _by_length(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), *make(_filled(x, dims))], names=["key", *names])

    return rows.select("key", "x").mapInArrow(run, f"key {kind}, {schema}")


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(np.ascontiguousarray(m, np.float64).ravel()))


def principal(centred: DataFrame, n: int, dims: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance, falling, and unit eigenvectors as columns, by computeSVD of rows `v`."""
    rows = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("v").alias("v")), "v")
    k = min(dims, max(most, dims // 2 + 1)) if dims <= DENSE else min(dims - 1, most)
    found = RowMatrix(rows, n, dims).computeSVD(k, False, LEAST_SHARE)
    values, vectors = np.array(found.s.toArray()), found.V.toArray()
    values, vectors = values[:most], vectors[:, :most]
    return values**2 / n, vectors


def _moments(white: DataFrame, k: int, centre: np.ndarray | None) -> np.ndarray:
    """Sums of w over all rows or, around a centre, of the products of its entries; a task sends one row for each sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k if centre is None else k * k)
        for b in batches:
            w = _rows(b.column(0))[0].reshape(-1, k)
            total = total + (w.sum(0) if centre is None else ((w - centre).T @ (w - centre)).ravel())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["i", "s"])

    found = {r.i: r.s for r in white.select("w").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    return np.array([found[i] for i in range(len(found))])


def identity_error(white: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of the covariance of w minus the identity, centred before multiplying."""
    mean = _moments(white, k, None) / n
    return float(np.abs(_moments(white, k, mean).reshape(k, k) / n - np.eye(k)).max())


def whitened(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 8) -> DataFrame:
    """(key, component, n, deviation decimal(38,0), whitened, explained, identity_error) of each row that takes part and each
    of up to `most` components. A deviation of over 38 digits is null."""
    small_batches(embeddings.sparkSession)
    schema = f"`{key}` {embeddings.schema[key].dataType.simpleString()}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    nothing = embeddings.sparkSession.createDataFrame([], schema)
    rows = stored(integers(embeddings, key, vector), "integers")
    n, sums = _sums(rows)
    dims = len(sums)
    if not n or not dims:
        return nothing
    whole, rest = _centre(n, sums)

    def deviations(x: np.ndarray) -> list[pa.Array]:
        own = _exact_deviations(x, n, whole, rest)
        return [pa.array([Decimal(d) if d < MOST_DECIMAL else None for d in own], pa.decimal128(38, 0)), pa.array([float(d) for d in own])]

    total = _each(rows, dims, "deviation decimal(38,0), about double", deviations, ["deviation", "about"]).agg(F.expr("cast(try_sum(deviation) as double)").alias("exact"), F.sum("about").alias("about"), F.count("deviation").alias("m")).first()
    trace = (total.exact if total.exact is not None and total.m == n else total.about) / float(n) ** 3
    if not trace:
        return nothing

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole) - rest / n

    values, vectors = principal(_each(rows, dims, "v array<double>", lambda x: [_lists(centred(x))], ["v"]), n, dims, most)
    k = len(values)
    to_white = vectors / np.sqrt(values)
    white = _each(rows, dims, "deviation decimal(38,0), w array<double>", lambda x: [deviations(x)[0], _lists(centred(x) @ to_white)], ["deviation", "w"])
    white = stored(white, "white")
    dropped(rows)
    error = identity_error(white, n, k)
    explained = F.element_at(F.array(*[F.lit(float(v / trace)) for v in values]), F.col("component"))
    each = white.select("key", "deviation", F.posexplode("w").alias("place", "whitened")).withColumn("component", F.col("place") + 1)
    return each.select(F.col("key").alias(key), "component", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
