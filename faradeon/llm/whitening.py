"""Embedding whitening: Welford moments by partition, merged in parallel, and a symmetric QR eigen-solve.

Vectors become integers, so that equal ones meet in a grouping and sums are exact. Over the list of distinct vectors
each partition's iterator updates its own count, mean and matrix of centred products by one rank-one update a vector;
the partitions' states, whose size is that of the matrix alone, are merged by the parallel formula, a few at a time,
level by level. The eigen-solve of the one matrix that is left (Householder tridiagonal form, then implicit QR steps
with Wilkinson's shift) takes place on the driver: its size follows the vectors' width and not the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, materialise

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
#: Scaled entries beyond this count as it, so that entries are longs and differences of two of them too.
LARGEST = 1 << 61
#: States that are merged in one group.
FAN = 16

STATE = "p long, n long, sums array<decimal(38,0)>, mean binary, m2 binary"
ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_LONG = 1 << 63


@dataclass
class Moments:
    """Count, exact sums, mean, and sums of centred products of vectors."""

    n: int
    sums: np.ndarray  # Python integers
    mean: np.ndarray
    m2: np.ndarray

    @classmethod
    def empty(cls, width: int) -> Moments:
        return cls(0, np.array([0] * width, object), np.zeros(width), np.zeros((width, width)))

    def update(self, rows: np.ndarray) -> None:
        """One rank-one update for each row of numbers; ``sums`` stay as they are."""
        step, n, mean, m2 = np.empty_like(self.m2), self.n, self.mean, self.m2
        for x in rows:
            n += 1
            delta = x - mean
            mean += delta / n
            np.multiply(delta[:, None], ((n - 1) / n * delta)[None, :], out=step)
            m2 += step
        self.n = n

    def merge(self, other: Moments) -> None:
        """The moments of both lists."""
        if not other.n:
            return
        n, delta = self.n + other.n, other.mean - self.mean
        self.m2 += other.m2 + np.outer(delta, delta) * (self.n / n * other.n)
        self.mean += delta * (other.n / n)
        self.sums = self.sums + other.sums
        self.n = n

    def row(self, p: int) -> pa.RecordBatch:
        values = [[p], [self.n], [[Decimal(int(x)) for x in self.sums]], [self.mean.astype("<f8").tobytes()], [self.m2.astype("<f8").tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _STATE, strict=True)], schema=_STATE)

    @classmethod
    def of(cls, row: dict) -> Moments:
        mean = np.frombuffer(row["mean"], "<f8").copy()
        return cls(row["n"], np.array([int(x) for x in row["sums"]], object), mean, np.frombuffer(row["m2"], "<f8").reshape(len(mean), -1).copy())


_STATE = pa.schema([("p", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("mean", pa.binary()), ("m2", pa.binary())])


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and orthogonal q with a = q t q', by Householder reflections."""
    a, n = np.array(a, np.float64), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        to = -math.copysign(float(np.linalg.norm(v)), v[0])
        v[0] -= to
        size = float(np.linalg.norm(v))
        if size == 0:
            continue
        v /= size
        rest = a[k + 1 :, k + 1 :]
        w = rest @ v
        w -= (v @ w) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k], a[k + 2 :, k] = to, 0
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows, each with its largest entry positive."""
    scale = float(np.abs(a).max(initial=0)) or 1.0
    diag, off, q = tridiagonal(a / scale)
    rows, hi, eps = np.ascontiguousarray(q.T), len(diag) - 1, np.finfo(float).eps
    while hi > 0:
        off[np.abs(off) <= eps * (np.abs(diag[:-1]) + np.abs(diag[1:]))] = 0
        while hi > 0 and off[hi - 1] == 0:
            hi -= 1
        if not hi:
            break
        lo = hi - 1
        while lo and off[lo - 1] != 0:
            lo -= 1
        half, b = (diag[hi - 1] - diag[hi]) / 2, off[hi - 1]
        shift = diag[hi] - b * b / (half + math.copysign(math.hypot(half, b), half))
        x, z = diag[lo] - shift, off[lo]
        for k in range(lo, hi):  # chase the bulge down
            r = math.hypot(x, z)
            c, s = (x / r, -z / r) if r else (1.0, 0.0)
            if k > lo:
                off[k - 1] = r
            d1, d2, o = diag[k], diag[k + 1], off[k]
            diag[k], diag[k + 1] = c * c * d1 - 2 * c * s * o + s * s * d2, s * s * d1 + 2 * c * s * o + c * c * d2
            off[k] = c * s * (d1 - d2) + (c * c - s * s) * o
            if k < hi - 1:
                x, z = off[k], -s * off[k + 1]
                off[k + 1] *= c
            rows[k], rows[k + 1] = c * rows[k] - s * rows[k + 1], s * rows[k] + c * rows[k + 1]
    order = np.argsort(-diag, kind="stable")
    rows = rows[order]
    rows *= np.where(rows[np.arange(len(rows)), np.abs(rows).argmax(1)] < 0, -1.0, 1.0)[:, None] if len(rows) else 1.0
    return diag[order] * scale, rows


def integer_vectors(df: DataFrame) -> DataFrame:
    """vec_id and x, array<long>: floor(64 * entry) + 1000000 of vectors that are whole and finite."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    whole = df.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda c: F.coalesce(bad(c.cast("double")), F.lit(True))))
    most = float(LARGEST)
    scaled = lambda c: F.least(F.greatest(c.cast("double") * SCALE, F.lit(-most)), F.lit(most))
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: F.floor(scaled(c)).cast("long") + SHIFT).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values)[offsets[0] : offsets[-1]].reshape(-1, width)


def exact_sums(m: np.ndarray) -> np.ndarray:
    """Sums of columns of longs as Python integers."""
    high, low = m >> 31, m & ((1 << 31) - 1)  # neither sum passes 64 bits within a batch
    return high.sum(0).astype(object) * (1 << 31) + low.sum(0).astype(object)


def _fit(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments.empty(width)
        for batch in batches:
            m = _matrix(batch.column(0), width)
            state.sums = state.sums + exact_sums(m)
            state.update(m.astype(np.float64))
        if state.n:
            yield state.row(TaskContext.get().partitionId())

    return run


def _merge(keys: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = None
    for batch in groups:
        for j in range(batch.num_rows):
            other = Moments.of(batch.slice(j, 1).select(_STATE.names).to_pylist()[0])
            if state is None:
                state = other
            else:
                state.merge(other)
    yield state.row(keys[0].as_py())


def merged(states: DataFrame) -> Moments | None:
    """All states as one: FAN at a time in tasks, the last few on the driver, one by one."""
    count = (states.agg(F.max("p")).first()[0] or 0) + 1
    while count > FAN:
        states = states.groupBy(F.floor(F.col("p") / FAN).cast("long").alias("q")).applyInArrow(_merge, STATE)
        count = -(-count // FAN)
    total = None
    for row in states.toLocalIterator():
        other = Moments.of(row.asDict())
        if total is None:
            total = other
        else:
            total.merge(other)
    return total


@dataclass
class Whitening:
    """What turns an integer vector x into whitened components."""

    n: int
    sums: np.ndarray  # Python integers
    values: np.ndarray  # eigenvalues of the components
    vectors: np.ndarray  # their unit eigenvectors, as rows
    trace: float

    @property
    def varied(self) -> np.ndarray:
        """Components whose eigenvalue stands out of rounding; the others have no variance to divide by."""
        return self.values > max(self.trace, 0.0) * len(self.sums) * np.finfo(float).eps

    def centred(self, m: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: longs where they hold it, else Python integers."""
        most = max((abs(int(x)) for x in (m.max(initial=0), m.min(initial=0), *self.sums)), default=0)
        if most * (self.n + 1) < 1 << 62:
            return m * self.n - self.sums.astype(np.int64)
        return m.astype(object) * self.n - self.sums

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened components; NaN where a component has no variance."""
        ok, x = self.varied, (centred / self.n).astype(np.float64)
        return np.where(ok, x @ self.vectors.T / np.sqrt(np.where(ok, self.values, 1.0)), np.nan)


def deviations(centred: np.ndarray) -> list[int]:
    """Sums of squares of rows, exactly; beyond 64 bits the largest long."""
    if centred.dtype != object:
        most = int(np.abs(centred).max(initial=0))
        if most * most * max(1, centred.shape[1]) < _LONG:
            return (centred * centred).sum(1).tolist()
        centred = centred.astype(object)
    return [min(int(x), _LONG - 1) for x in (centred * centred).sum(1)]


def _projected(w: Whitening):
    width, ok = len(w.sums), w.varied

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments.empty(int(ok.sum()))
        for batch in batches:
            state.update(w.project(w.centred(_matrix(batch.column(0), width)))[:, ok])
        if state.n:
            yield state.row(TaskContext.get().partitionId())

    return run


def _whiten(w: Whitening, error: float):
    width, k = len(w.sums), len(w.values)
    explained = w.values / w.trace if w.trace > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            centred = w.centred(_matrix(batch.column(1), width))
            white = w.project(centred).reshape(-1)
            each = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, w.n, np.int64)), pa.array(deviations(centred), pa.int64()).take(pa.array(each)),
                 pa.array(white, mask=np.isnan(white)), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row a vector and component.

    ``df`` has vec_id and embedding (array of floats or doubles); other columns are ignored. Null vectors and vectors
    with null or non-finite entries take no part; null vec_ids and repeated ones are rows like any other. The model is
    fitted on each distinct integer vector once (``n`` of them), whatever their copies. Shorter vectors count as ending
    in zeros; entries beyond 2^61 after scaling count as that. Tied eigenvalues come in any order of their plane. A
    component without variance has null in ``whitened`` and is left out of identity_error, which is measured on the
    whitened fit list by a second pass; if none has variance it is 0. A deviation beyond 64 bits shows the largest
    long. An empty table, or vectors without entries, give no rows.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    rows = integer_vectors(df)
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not width:
        return spark.createDataFrame([], ROWS)
    short = F.size("x") < width
    rows = rows.withColumn("x", F.when(short, F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(width) - F.size("x")))).otherwise(F.col("x")))
    # copies combine before the shuffle
    fit = materialise(rows.select("x").distinct(), "fit-list")
    total = merged(materialise(fit.mapInArrow(_fit(width), STATE), "moments"))
    values, vectors = symmetric_qr(total.m2 / total.n)
    k = min(components, width)
    model = Whitening(total.n, total.sums, values[:k], vectors[:k], float(np.trace(total.m2)) / total.n)
    error = 0.0
    if model.varied.any():
        white = merged(materialise(fit.mapInArrow(_projected(model), STATE), "whitened-moments"))
        error = float(np.abs(white.m2 / white.n - np.eye(len(white.m2))).max())
    return rows.mapInArrow(_whiten(model, error), ROWS)
