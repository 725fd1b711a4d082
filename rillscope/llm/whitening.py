"""Embedding whitening: Welford updates merged in parallel, then a symmetric QR eigen-solve.

Rows whose vector is null or holds a null or non-finite entry go.  Each entry c
becomes the integer floor(256 c).  The fit list is each distinct integer vector
once; it is written once and read twice.

Every input task streams its vectors through Welford's update: the mean moves by
d/n, and the sum of products grows by the rank-one matrix d (x - mean)^T, which
is centred before it is multiplied.  States (one per task) meet in groups of
FAN_IN by the update formula for two parts, over as many rounds as it takes, so
no task holds more than FAN_IN matrices and the driver receives one.

Defined cases: the vectors' length is the most frequent one (of ties the
larger); rows of another length give no result rows, and neither does an empty
table.  ``whitened`` is null in a component without variance (an eigenvalue at
rounding level), which then counts in no figure of the identity error;
``explained`` is null where the trace is zero.  A deviation beyond a long is
null, and an entry beyond a long is the nearest long.  Repeated rows and rows
with a null id are rows like all others; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize

SCALE = 256
COMPONENTS = 4
FAN_IN = 32
LONG_MAX = (1 << 63) - 1
STATE = "part bigint, n bigint, sums array<decimal(38,0)>, mean array<double>, products array<double>"


def quantised(vector: str) -> Column:
    """floor(256 c) of each entry, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))).cast("long"))


def whole_vectors(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, x) of the rows whose vector has no null and no non-finite entry."""
    fits = F.col(vector_column).isNotNull() & F.forall(vector_column, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    return table.select(F.col(id_column).alias("vec_id"), F.when(fits, quantised(vector_column)).alias("x")).where("x is not null")


class Welford:
    """Count, mean and centred sum of products of vectors of length ``d``; ``sums`` are exact where entries are integers."""

    def __init__(self, d: int):
        self.n, self.sums = 0, [0] * d
        self.mean, self.products = np.zeros(d), np.zeros((d, d))

    def add(self, rows: np.ndarray) -> None:
        """One rank-one update per row."""
        mean, products, outer = self.mean, self.products, np.empty_like(self.products)
        for x in rows.astype(np.float64):
            self.n += 1
            before = x - mean
            mean += before / self.n
            np.multiply(before[:, None], (x - mean)[None, :], out=outer)
            products += outer
        if rows.dtype.kind == "i" and len(rows):
            small = max(abs(int(rows.min())), abs(int(rows.max()))) < LONG_MAX // len(rows)
            added = (rows if small else rows.astype(object)).sum(axis=0)
            self.sums = [a + int(b) for a, b in zip(self.sums, added, strict=True)]

    def merge(self, n: int, sums: list[int], mean: np.ndarray, products: np.ndarray) -> None:
        """Add what another part has seen."""
        if not n:
            return
        total, apart = self.n + n, mean - self.mean
        self.products += products + np.outer(apart, apart) * (self.n * n / total)
        self.mean += apart * (n / total)
        self.n, self.sums = total, [a + b for a, b in zip(self.sums, sums, strict=True)]

    def covariance(self) -> np.ndarray:
        return (self.products + self.products.T) / (2 * self.n)

    def row(self, part: int) -> pd.DataFrame:
        return pd.DataFrame({"part": [part], "n": [self.n], "sums": [[Decimal(s) for s in self.sums]], "mean": [self.mean.tolist()], "products": [self.products.ravel().tolist()]})


def _matrix(column: pa.Array, d: int, kind: str) -> np.ndarray:
    """Rows of a list column without nulls, all of length ``d``."""
    flat = column.flatten() if hasattr(column, "flatten") else column
    return np.asarray(flat, dtype=kind).reshape(-1, d)


def moments(vectors: DataFrame, column: str, d: int) -> Welford:
    """Count, sums, mean and products of a column of vectors of length ``d``; the driver receives one state."""
    kind = "int64" if dict(vectors.dtypes)[column] == "array<bigint>" else "float64"

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = Welford(d)
        for batch in batches:
            state.add(_matrix(batch.column(0), d, kind))
        if state.n:
            yield pa.RecordBatch.from_pandas(state.row(TaskContext.get().partitionId()), schema=_ARROW, preserve_index=False)

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state = Welford(d)
        for _, r in rows.sort_values("part").iterrows():
            state.merge(int(r.n), [int(s) for s in r.sums], np.asarray(r["mean"], float), np.asarray(r["products"], float).reshape(d, d))
        return state.row(int(key[0]))

    states = materialize(vectors.sparkSession, vectors.select(column).mapInArrow(stream, STATE), "moments")
    while (left := states.count()) > 1:
        # Numbered anew, so that a round leaves one of FAN_IN however the numbers lie.
        groups = -(-left // FAN_IN)
        states = materialize(vectors.sparkSession, states.groupBy(F.pmod("part", F.lit(groups)).alias("k")).applyInPandas(meet, STATE), "moments")
    out = Welford(d)
    for r in states.collect():  # one row, or none
        out.merge(r.n, [int(s) for s in r.sums], np.array(r["mean"]), np.array(r["products"]).reshape(d, d))
    return out


_ARROW = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("mean", pa.list_(pa.float64())), ("products", pa.list_(pa.float64()))])


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and Q^T with Q^T A Q tridiagonal, by Householder reflections."""
    a, q = a.astype(np.float64).copy(), np.eye(len(a))
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        length = math.sqrt(float(v @ v))
        if length == 0:
            continue
        v[0] += math.copysign(length, v[0])
        v /= math.sqrt(float(v @ v))
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[k + 1 :] -= 2 * np.outer(v, v @ q[k + 1 :])
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors (rows) of a symmetric matrix.

    Implicit QR steps with Wilkinson's shift on the tridiagonal form; an
    off-diagonal entry at rounding level splits the matrix.
    """
    d, e, q = tridiagonal(a)
    hi, eps = len(d) - 1, np.finfo(float).eps
    while hi > 0:
        small = np.abs(e[:hi]) <= eps * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0.0
        if e[hi - 1] == 0:
            hi -= 1
            continue
        zeros = np.flatnonzero(e[:hi] == 0)
        lo = int(zeros[-1]) + 1 if len(zeros) else 0
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + math.copysign(math.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            dk, dn, ek = d[k], d[k + 1], e[k]
            d[k] = c * c * dk + 2 * c * s * ek + s * s * dn
            d[k + 1] = s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
            if k + 1 < hi:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
    order = np.argsort(-d, kind="stable")
    return d[order], q[order]


def whiten(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each whole vector and leading component."""
    spark = table.sparkSession
    out = f"{id_column} {dict(table.dtypes)[id_column]}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    vectors = whole_vectors(table, id_column, vector_column)
    lengths = vectors.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).first()
    if lengths is None or not lengths.d:
        return spark.createDataFrame([], out)
    d = lengths.d
    vectors = vectors.where(F.size("x") == d)
    fit = materialize(spark, vectors.select("x").distinct(), "fit-list")
    found = moments(fit, "x", d)
    values, axes = symmetric_qr(found.covariance())
    most = min(components, d)
    values, axes, trace = values[:most], axes[:most], float(np.trace(found.covariance()))
    live = values > d * np.finfo(float).eps * max(trace, 0.0)
    n, sums = found.n, found.sums
    scaled = axes / np.sqrt(np.where(live, values, 1.0))[:, None]

    def away(x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        top = n * max(1, abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums)) if len(x) else 0
        wide = x if top < 1 << 62 else x.astype(object)
        return wide * n - np.array(sums, dtype=wide.dtype)

    def projected(x: np.ndarray) -> np.ndarray:
        return (away(x).astype(np.float64) / n) @ scaled.T

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = projected(_matrix(batch.column(0), d, "int64"))[:, live]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))], names=["w"])

    error = None
    if live.any():
        again = moments(fit.mapInArrow(whitened, "w array<double>"), "w", int(live.sum()))
        error = float(np.abs(again.covariance() - np.eye(int(live.sum()))).max())
    explained = [float(v / trace) if trace > 0 else None for v in values]

    def deviations(x: np.ndarray) -> list[int | None]:
        far = away(x)
        if far.dtype == object or not len(far) or float(np.abs(far).max()) ** 2 * d >= float(1 << 62):
            exact = (far.astype(object) ** 2).sum(axis=1)
            return [int(v) if v <= LONG_MAX else None for v in exact]
        return (far * far).sum(axis=1).tolist()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), d, "int64")
            w, m = projected(x), len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), most))),
                    pa.array(np.tile(np.arange(1, most + 1), m), pa.int32()),
                    pa.array(np.full(m * most, n), pa.int64()),
                    pa.array(deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), most))),
                    pa.array(w.ravel(), mask=np.tile(~live, m)),
                    pa.array(explained * m, pa.float64()),
                    pa.array([error] * (m * most), pa.float64()),
                ],
                names=[id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(rows, out)
