"""Fits of single series: polynomial with harmonics, outliers, moving fits and medians, ellipses; one task a group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def basis(x: np.ndarray, degree: int = 3, harmonics: int = 3) -> np.ndarray:
    """Columns: powers of x scaled to [-1, 1], cosines and sines of whole periods over the range."""
    span = np.ptp(x) or 1.0
    s = 2 * (x - x.min()) / span - 1
    t = np.pi * (s + 1)
    return np.column_stack([*(s**k for k in range(degree + 1)), *(f(k * t) for k in range(1, harmonics + 1) for f in (np.cos, np.sin))])


def poly_harm_fit(x: np.ndarray, y: np.ndarray, degree: int = 3, harmonics: int = 3) -> np.ndarray:
    """Fitted values at ``x``; NaN values of y are left out of the fit."""
    m, ok = basis(np.asarray(x, np.float64), degree, harmonics), ~np.isnan(y)
    if not ok.any():
        return np.full(len(y), np.nan)
    return m @ np.linalg.lstsq(m[ok], y[ok], rcond=None)[0]


def moving_fit(x: np.ndarray, y: np.ndarray, window: int, degree: int = 3, harmonics: int = 3) -> np.ndarray:
    """Fits in windows that overlap by half, blended by triangular weights."""
    n = len(y)
    if n <= window:
        return poly_harm_fit(x, y, degree, harmonics)
    total, weight, step = np.zeros(n), np.zeros(n), max(1, window // 2)
    starts = [*range(0, n - window, step), n - window]
    w = 1 - np.abs(np.linspace(-1, 1, window + 2)[1:-1])
    for a in starts:
        total[a : a + window] += w * poly_harm_fit(x[a : a + window], y[a : a + window], degree, harmonics)
        weight[a : a + window] += w
    return total / weight


def moving_median(y: np.ndarray, n: int, step: int) -> np.ndarray:
    """Upper medians of blocks of ``n`` every ``step`` values; values under several blocks get the mean of their
    medians, values past the last whole block the median of what is left."""
    y = np.asarray(y, np.float64)
    total, times = np.zeros(len(y)), np.zeros(len(y))
    mid = lambda v: np.sort(v)[len(v) // 2]
    a = 0
    while a + n <= len(y):
        total[a : a + n] += mid(y[a : a + n])
        times[a : a + n] += 1
        a += step
    rest = np.flatnonzero(times == 0)
    if len(rest):
        total[rest], times[rest] = mid(y[rest]), 1
    return total / times


def _per_group(df: DataFrame, by: list[str], x: str, y: str, fit) -> DataFrame:
    def run(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        xs, ys = (table[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (x, y))
        order = np.argsort(xs, kind="stable")
        found = np.empty(len(xs))
        found[order] = fit(xs[order], ys[order])
        return table.select([*by, x, y]).append_column("fit", pa.array(found))

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by, x, y).schema]
    return df.select(*by, x, y).groupBy(*by).applyInArrow(run, ", ".join([*names, "fit double"]))


def fitted(df: DataFrame, by: list[str], x: str, y: str, degree: int = 3, harmonics: int = 3, window: int | None = None) -> DataFrame:
    """Rows with ``fit``; a group is one series (a spectrum or a time line), whose length is that of its axis."""
    if window:
        return _per_group(df, by, x, y, lambda a, b: moving_fit(a, b, window, degree, harmonics))
    return _per_group(df, by, x, y, lambda a, b: poly_harm_fit(a, b, degree, harmonics))


def median_smoothed(df: DataFrame, by: list[str], x: str, y: str, n: int, step: int) -> DataFrame:
    return _per_group(df, by, x, y, lambda a, b: moving_median(b, n, step))


def outliers(df: DataFrame, by: list[str], x: str, y: str, sigmas: float = 2.0, degree: int = 3, harmonics: int = 3) -> DataFrame:
    """Rows of a series whose residual from the fit is over ``sigmas`` rms of all its residuals: candidates for a list of bad channels."""
    with_fit = fitted(df, by, x, y, degree, harmonics).withColumn("residual", F.col(y) - F.col("fit"))
    rms = with_fit.groupBy(*by).agg(F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rms"))
    return with_fit.join(rms, by).where(F.abs("residual") > sigmas * F.col("rms"))


def bandpass_flags(df: DataFrame, by: list[str], x: str, y: str, mask_value: float, sigmas: float = 3.0, window: int = 32) -> DataFrame:
    """Rows with ``smooth`` and ``good`` (0 or 1): masked values are left out, values over ``sigmas`` rms off are bad."""
    value = F.when(F.col(y) == mask_value, F.lit(float("nan"))).otherwise(F.col(y).cast("double"))
    with_fit = fitted(df.withColumn(y, value), by, x, y, window=window).withColumnRenamed("fit", "smooth")
    off = F.when(~F.isnan(y), F.col(y) - F.col("smooth"))
    rms = with_fit.groupBy(*by).agg(F.sqrt(F.avg(off * off)).alias("rms"))
    return with_fit.join(rms, by).withColumn("good", F.when(F.isnan(y) | (F.abs(off) > sigmas * F.col("rms")), 0).otherwise(1)).drop("rms")


def fit_ellipse(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float, float]:
    """(centre x, centre y, major and minor half axis, angle) of the least-squares ellipse through points."""
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    mx, my = x.mean(), y.mean()
    u, v = x - mx, y - my
    d1, d2 = np.column_stack([u * u, u * v, v * v]), np.column_stack([u, v, np.ones(len(u))])
    t = -np.linalg.solve(d2.T @ d2, d2.T @ d1)
    m = d1.T @ d1 + d1.T @ d2 @ t
    _, vec = np.linalg.eig(np.array([m[2] / 2, -m[1], m[0] / 2]))
    vec = vec.real
    a1 = vec[:, np.argmax(4 * vec[0] * vec[2] - vec[1] ** 2)]
    a, b, c = a1
    d, e, f = t @ a1
    centre = np.linalg.solve([[2 * a, b], [b, 2 * c]], [-d, -e])
    level = -(f + (d * centre[0] + e * centre[1]) / 2)
    values, axes = np.linalg.eigh([[a / level, b / 2 / level], [b / 2 / level, c / level]])
    return mx + centre[0], my + centre[1], values[0] ** -0.5, values[1] ** -0.5, float(np.arctan2(axes[1, 0], axes[0, 0]))
