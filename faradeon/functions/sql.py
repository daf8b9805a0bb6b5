"""Functions for SQL users: table functions over pixels' samples and spectra, FITS headers, and scalar functions.

``register(spark)`` makes them known to a session:

- ``rm_synthesis(TABLE(samples) PARTITION BY (x, y), beg => -40, end => 40, n => 41)``: x, y, irm, rm, re, im, w
- ``rm_clean(TABLE(samples) PARTITION BY (x, y), ..., gain => 0.1, threshold => 3, niter => 1000)``: x, y, irm, rm, component_re,
  component_im, re, im
- ``peak_map(TABLE(spectra) PARTITION BY (x, y))``: x, y, peak, rm_peak, ang_peak, snr
- ``fits_header(path)``: key, value, kind; ``fits_header(path, keys => 'NAXIS1, CRVAL3')``: a column for each key
- ``amplitude(q, u)``, ``pol_angle(q, u)``, ``lambda_squared(mhz)``, ``fractional_polarisation(q, u, i)``

``samples`` has x, y, lsq (or freq, in MHz), q, u and, if not all are good, w; ``spectra`` has x, y, rm, re, im. Columns are taken by name, in
any order, and others are ignored. Samples of a pixel may come in any order and number of batches: the transform keeps
sums by depth alone. Table functions work on Arrow batches; the scalar functions are SQL expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.clean import clean_all, wide_beam
from ..operators.cubestat import peak_of
from .axes import C_MHZ, Axes, rm_axis, templates

SYNTHESIS = "x int, y int, irm int, rm double, re double, im double, w int"
CLEANED = "x int, y int, irm int, rm double, component_re double, component_im double, re double, im double"
PEAKS = "x int, y int, peak double, rm_peak double, ang_peak double, snr double"
HEADER = StructType([StructField(c, StringType()) for c in ("key", "value", "kind")])

#: Scalar functions as SQL expressions.
SCALARS = {
    "amplitude(q DOUBLE, u DOUBLE)": "sqrt(q * q + u * u)",
    "pol_angle(q DOUBLE, u DOUBLE)": "0.5 * atan2(u, q)",
    "lambda_squared(mhz DOUBLE)": f"pow({C_MHZ} / mhz, 2)",
    "fractional_polarisation(q DOUBLE, u DOUBLE, i DOUBLE)": "CASE WHEN i = 0 THEN NULL ELSE sqrt(q * q + u * u) / i END",
}


def _checked(batch: pa.RecordBatch, needed: tuple[str, ...], what: str) -> None:
    if missing := [c for c in needed if c not in batch.schema.names]:
        raise ValueError(f"{what}: the table has no column {', '.join(missing)}")


def _axis(beg: pa.Array, end: pa.Array, n: pa.Array) -> np.ndarray:
    beg, end, n = (v[0].as_py() for v in (beg, end, n))
    if beg is None or end is None or n is None or n < 1 or end < beg:
        raise ValueError(f"{n} depths from {beg} to {end}")
    return rm_axis(float(beg), float(end), int(n))


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column as doubles; NaN for null."""
    return np.asarray(batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)


class _Pixel:
    """What the functions over one pixel's rows share: its place, which must be one."""

    def __init__(self) -> None:
        self.at: tuple | None = None

    def see(self, batch: pa.RecordBatch, what: str, *needed: str) -> None:
        _checked(batch, ("x", "y", *needed), what)
        x, y = (batch.column(c).unique().to_pylist() for c in ("x", "y"))
        if len(x) > 1 or len(y) > 1 or self.at not in (None, (x[0], y[0])):
            raise ValueError("rows of several pixels came together: add PARTITION BY (x, y)")
        self.at = x[0], y[0]

    def rows(self, kinds: str, **columns) -> pa.Table:
        n = max(len(v) for v in columns.values())
        types = {"int": pa.int32(), "double": pa.float64()}
        fields = [f.split() for f in kinds.split(", ")]
        values = {"x": [self.at[0]] * n, "y": [self.at[1]] * n} | columns
        return pa.table({f: pa.array(values[f], types[t], from_pandas=True) for f, t in fields})


def _samples(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lsq, q, u, w); samples with a null or NaN have no weight."""
    lsq = _numbers(batch, "lsq") if "lsq" in batch.schema.names else (C_MHZ / _numbers(batch, "freq")) ** 2
    q, u = _numbers(batch, "q"), _numbers(batch, "u")
    w = np.nan_to_num(_numbers(batch, "w")) if "w" in batch.schema.names else np.ones(len(q))
    bad = np.isnan(q) | np.isnan(u) | np.isnan(lsq)
    return (np.where(bad, 0, v) for v in (lsq, q, u, w))


class RmSynthesis(_Pixel):
    """Sums by depth, so that neither the order nor the number of samples matters."""

    def eval(self, samples: pa.RecordBatch, beg: pa.Array, end: pa.Array, n: pa.Array) -> Iterator[pa.Table]:
        if samples.num_rows:
            self.see(samples, "rm_synthesis", "q", "u", "lsq" if "freq" not in samples.schema.names else "freq")
            if not hasattr(self, "rm"):
                self.rm = _axis(beg, end, n)
                self.re, self.im, self.w = np.zeros(len(self.rm)), np.zeros(len(self.rm)), 0.0
            lsq, q, u, w = _samples(samples)
            c, s = templates(self.rm, lsq)
            self.re += c @ (w * q) + s @ (w * u)
            self.im += c @ (w * u) - s @ (w * q)
            self.w += w.sum()
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        if self.at is not None:
            re, im = (v / self.w if self.w else np.full(len(v), np.nan) for v in (self.re, self.im))
            yield self.rows(SYNTHESIS, irm=np.arange(len(re), dtype=np.int32), rm=self.rm, re=re, im=im, w=np.full(len(re), int(self.w), np.int32))


class RmClean(_Pixel):
    """Keeps a pixel's samples, as many as it has channels."""

    def eval(self, samples: pa.RecordBatch, beg: pa.Array, end: pa.Array, n: pa.Array, gain: pa.Array | None = None, threshold: pa.Array | None = None, niter: pa.Array | None = None) -> Iterator[pa.Table]:
        if samples.num_rows:
            self.see(samples, "rm_clean", "q", "u", "lsq" if "freq" not in samples.schema.names else "freq")
            given = lambda a, default: default if a is None else a[0].as_py()
            self.rm = _axis(beg, end, n)
            self.how = float(given(gain, 0.1)), float(given(threshold, 3.0)), int(given(niter, 1000))
            self.held = [*getattr(self, "held", []), np.array([*_samples(samples)])]
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        if self.at is None:
            return
        lsq, q, u, w = np.concatenate(self.held, 1)
        order = np.lexsort((u, q, lsq))  # whatever order the samples came in
        lsq, q, u, w = lsq[order], q[order], u[order], w[order]
        axes = Axes(lsq, self.rm, np.ones(len(lsq), bool))
        c, s = templates(self.rm, lsq)
        total = w.sum() or np.nan
        spectrum = ((c @ (w * q) + s @ (w * u)) + 1j * (c @ (w * u) - s @ (w * q))) / total
        wide = wide_beam(axes, w)
        parts, left, _ = clean_all(spectrum[None], axes, w[None], *self.how, wide=None if wide is None else (wide[None], np.zeros(1, int)))
        yield self.rows(CLEANED, irm=np.arange(len(self.rm), dtype=np.int32), rm=self.rm, component_re=parts[0].real, component_im=parts[0].imag, re=left[0].real, im=left[0].imag)


class PeakMap(_Pixel):
    """Keeps a pixel's spectrum, as long as the depth axis."""

    def eval(self, spectra: pa.RecordBatch) -> Iterator[pa.Table]:
        if spectra.num_rows:
            self.see(spectra, "peak_map", "rm", "re", "im")
            self.held = [*getattr(self, "held", []), np.array([_numbers(spectra, c) for c in ("rm", "re", "im")])]
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        if self.at is not None:
            rm, re, im = np.concatenate(self.held, 1)
            order = np.argsort(rm, kind="stable")
            rm, re, im = rm[order], re[order], im[order]
            peak, depth, angle, snr = peak_of(np.hypot(re, im)[None], np.arctan2(im, re)[None], rm)
            yield self.rows(PEAKS, peak=peak, rm_peak=depth, ang_peak=angle, snr=snr)


def _header(path: str) -> dict:
    from ..sources.fits_format import read_header

    with open(path, "rb") as f:
        return read_header(f).cards


class FitsHeader:
    """All cards as rows; or, with ``keys``, one row with a column of its own type for each key."""

    @staticmethod
    def analyze(path: AnalyzeArgument, keys: AnalyzeArgument | None = None) -> AnalyzeResult:
        if path.isTable or not path.isConstantExpression or not path.value:
            raise ValueError("fits_header takes a constant path")
        if keys is None or not keys.value:
            return AnalyzeResult(HEADER)
        cards, kinds = _header(path.value), {bool: BooleanType(), int: LongType(), float: DoubleType()}
        return AnalyzeResult(StructType([StructField(k, kinds.get(type(cards.get(k)), StringType())) for k in _keys(keys.value)]))

    def eval(self, path: str, keys: str | None = None) -> Iterator[tuple]:
        cards = _header(path)
        if keys:
            yield tuple(cards.get(k) for k in _keys(keys))
        else:
            yield from ((k, str(v), type(v).__name__) for k, v in cards.items())


def _keys(keys: str) -> list[str]:
    return [k.strip().upper() for k in keys.split(",") if k.strip()]


#: Table functions over pixels and what they give. Their types are fixed, as Spark 4.1 lets no Arrow function name its own.
TABLES = {"rm_synthesis": (RmSynthesis, SYNTHESIS), "rm_clean": (RmClean, CLEANED), "peak_map": (PeakMap, PEAKS)}


def register(spark: SparkSession) -> None:
    """Make the functions known to a session."""
    for name, (handler, schema) in TABLES.items():
        spark.udtf.register(name, arrow_udtf(handler, returnType=schema))
    spark.udtf.register("fits_header", udtf(FitsHeader))
    for signature, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS DOUBLE RETURN {body}")
