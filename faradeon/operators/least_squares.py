"""Least squares by sums that merge: any number of points a group, combined before the shuffle.

The Gram matrix and the right side of a fit are sums of products of basis columns, so partial sums of any cut of the
rows add up. What is shuffled and solved is a row a group, whatever its number of points; many groups are solved at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gram(df: DataFrame, by: list[str], basis: list[Column], value: Column | None = None) -> DataFrame:
    """by, _gram (upper triangle of the Gram matrix, row by row), _right (the right side, if there is a value) and n of each group."""
    k = len(basis)
    named = df.select(*by, *(b.cast("double").alias(f"_b{j}") for j, b in enumerate(basis)), *([value.cast("double").alias("_v")] if value is not None else []))
    whole = named.dropna(subset=[c for c in named.columns if c not in by])
    g = [F.sum(F.col(f"_b{i}") * F.col(f"_b{j}")) for i in range(k) for j in range(i, k)]
    out = whole.groupBy(*by).agg(F.array(*g).alias("_gram"), *([F.array(*(F.sum(F.col(f"_b{i}") * F.col("_v")) for i in range(k))).alias("_right")] if value is not None else []), F.count("*").alias("n"))
    return out


def _square(flat: np.ndarray, k: int) -> np.ndarray:
    out, (i, j) = np.empty((len(flat), k, k)), np.triu_indices(k)
    out[:, i, j] = out[:, j, i] = flat
    return out


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def least_squares(df: DataFrame, by: list[str], basis: list[Column], value: Column, rcond: float = 1e-13) -> DataFrame:
    """by, coefficients (array by basis column), n: the fit of each group; of a group that leaves some undetermined, the
    least coefficients in units of the columns' sizes. Rows with a null or NaN take no part; groups without other rows have no row."""
    k = len(basis)
    sums = gram(df, by, [F.nanvl(b.cast("double"), F.lit(None)) for b in basis], F.nanvl(value.cast("double"), F.lit(None)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            g, r = _square(_rows(b.column(len(by))), k), _rows(b.column(len(by) + 1))
            scale = np.sqrt(np.maximum(np.einsum("nii->ni", g), 1e-300))
            found = np.einsum("nij,nj->ni", np.linalg.pinv(g / scale[:, :, None] / scale[:, None, :], rcond=rcond, hermitian=True), r / scale) / scale
            lists = pa.ListArray.from_arrays(np.arange(len(r) + 1, dtype=np.int32) * k, pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(len(by))), lists, b.column(len(by) + 2)], names=[*by, "coefficients", "n"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*by).schema)
    return sums.mapInArrow(run, f"{kinds}{', ' if by else ''}coefficients array<double>, n long")


def fitted_values(df: DataFrame, fit: DataFrame, by: list[str], basis: list[Column], name: str = "fit") -> DataFrame:
    """``df`` with the fit's value at each row."""
    value = sum((F.col("_coefficients")[k] * b for k, b in enumerate(basis)), F.lit(0.0))
    return df.join(fit.select(*by, F.col("coefficients").alias("_coefficients")), by).withColumn(name, value).drop("_coefficients")


def ellipses(df: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """by, x0, y0, major, minor, angle, n: the least-squares ellipse through each group's points; nulls where there is none.

    Two passes of sums: means, then products of up to four about the means, which hold all that the fit needs. The
    constrained problem is solved on 3 by 3 matrices of sums, all groups of a batch at once.
    """
    whole = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x is not null and _y is not null and not isnan(_x) and not isnan(_y)")
    means = whole.groupBy(*by).agg(F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"), F.sqrt(F.var_pop("_x") + F.var_pop("_y")).alias("_s"))
    scaled = whole.join(means, by) if by else whole.crossJoin(F.broadcast(means))  # one row
    s = F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    u, v = (F.col("_x") - F.col("_mx")) / s, (F.col("_y") - F.col("_my")) / s
    placed = scaled.withColumns({"_u": u, "_v": v}).groupBy(*by)
    moments = [(p, q) for d in range(5) for p in range(d, -1, -1) for q in [d - p]]
    powers = lambda p, q: F.pow("_u", F.lit(p)) * F.pow("_v", F.lit(q))
    sums = placed.agg(F.array(*(F.sum(powers(p, q)) for p, q in moments)).alias("_m"), F.first("_mx").alias("_x0"), F.first("_my").alias("_y0"), F.first(s).alias("_size"), F.count("*").alias("n"))
    place = {m: k for k, m in enumerate(moments)}
    terms = [(2, 0), (1, 1), (0, 2), (1, 0), (0, 1), (0, 0)]
    at = np.array([[place[a[0] + b[0], a[1] + b[1]] for b in terms] for a in terms])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = _rows(b.column(len(by)))
            mx, my, size, n = (np.asarray(b.column(len(by) + k), np.float64) for k in range(1, 5))
            found = np.full((len(m), 5), np.nan)
            with np.errstate(all="ignore"):
                g = m[:, at]
                ok = (n >= 5) & (np.linalg.matrix_rank(g[:, 3:, 3:], hermitian=True) == 3)
                t = np.zeros((len(m), 3, 3))
                t[ok] = -np.linalg.solve(g[ok][:, 3:, 3:], g[ok][:, 3:, :3])
                r = g[:, :3, :3] + g[:, :3, 3:] @ t
                system = np.stack([r[:, 2] / 2, -r[:, 1], r[:, 0] / 2], 1)
                _, vec = np.linalg.eig(system)
                vec = vec.real
                kind = 4 * vec[:, 0] * vec[:, 2] - vec[:, 1] ** 2
                best = np.take_along_axis(vec, kind.argmax(1)[:, None, None], 2)[:, :, 0]
                ok &= kind.max(1) > 0
                (A, B, C), (D, E, G) = best.T, np.einsum("nij,nj->ni", t, best).T
                det = 4 * A * C - B * B
                cx, cy = (B * E - 2 * C * D) / det, (B * D - 2 * A * E) / det
                level = -(G + (D * cx + E * cy) / 2)
                shape = np.stack([np.stack([A, B / 2], 1), np.stack([B / 2, C], 1)], 1) / level[:, None, None]
                ok &= np.isfinite(shape).all((1, 2))
                values, axes = np.linalg.eigh(shape[ok])
                angle = np.mod(np.arctan2(axes[:, 1, 0], axes[:, 0, 0]), np.pi)
                found[ok] = np.column_stack([mx[ok] + size[ok] * cx[ok], my[ok] + size[ok] * cy[ok], size[ok] / np.sqrt(values[:, 0]), size[ok] / np.sqrt(values[:, 1]), angle])
            found[~np.isfinite(found).all(1)] = np.nan
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(len(by))), *(pa.array(c, from_pandas=True) for c in found.T), b.column(len(by) + 4)], names=[*by, "x0", "y0", "major", "minor", "angle", "n"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*by).schema)
    return sums.mapInArrow(run, f"{kinds}{', ' if by else ''}x0 double, y0 double, major double, minor double, angle double, n long")


def series_basis(x: Column, first: Column, last: Column, degree: int = 3, harmonics: int = 3) -> list[Column]:
    """Powers of x scaled to [-1, 1] over [first, last], cosines and sines of whole periods over it."""
    span = F.when(last > first, last - first).otherwise(1.0)
    s = 2 * (x - first) / span - 1
    t = np.pi * (s + 1)
    return [*(F.pow(s, F.lit(float(k))) if k else F.lit(1.0) for k in range(degree + 1)), *(f(k * t) for k in range(1, harmonics + 1) for f in (F.cos, F.sin))]


def series_fit(df: DataFrame, by: list[str], x: str, y: str, degree: int = 3, harmonics: int = 3) -> DataFrame:
    """by, x, y, fit: polynomial and harmonics through series of any length, by merged sums; null and NaN y take no part in the fit."""
    ends = df.groupBy(*by).agg(F.min(x).alias("_first"), F.max(x).alias("_last"))
    rows = df.select(*by, x, y).join(ends, by)
    basis = series_basis(F.col(x).cast("double"), F.col("_first").cast("double"), F.col("_last").cast("double"), degree, harmonics)
    value = F.nanvl(F.col(y).cast("double"), F.lit(None))
    return fitted_values(rows, least_squares(rows, by, basis, value), by, basis).drop("_first", "_last")


def residual_outliers(df: DataFrame, by: list[str], x: str, y: str, sigmas: float = 2.0, degree: int = 3, harmonics: int = 3) -> DataFrame:
    """Rows whose residual from ``series_fit`` is over ``sigmas`` rms of all residuals of the series."""
    rows = series_fit(df, by, x, y, degree, harmonics).withColumn("residual", F.col(y) - F.col("fit"))
    rms = F.sqrt(F.avg(F.col("residual") * F.col("residual")).over(Window.partitionBy(*by)))
    return rows.withColumn("rms", rms).where(F.abs("residual") > sigmas * F.col("rms"))
