"""Fourier transforms of planes: power spectrum, autocorrelation, convolution, alignment.

Spectra and autocorrelations of cubes go line by line along one axis, then along the other, so a task holds one
line. ``per_plane`` takes any kernel, with a whole plane in one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fft(values: np.ndarray, inverse: bool = False, shift: bool = False) -> np.ndarray:
    """1-D or 2-D transform over all axes; the inverse divides by the count. ``shift`` puts frequency 0 in the middle."""
    out = (np.fft.ifftn if inverse else np.fft.fftn)(values)
    return np.fft.fftshift(out) if shift else out


def power_spectrum(image: np.ndarray) -> np.ndarray:
    """|FFT / N|^2 of the image less its mean, frequency 0 in the middle."""
    image = np.asarray(image)
    f = np.fft.fftn(image - image.mean()) / image.size
    return np.fft.fftshift(np.abs(f) ** 2)


def autocorrelation(image: np.ndarray) -> np.ndarray:
    """Inverse transform of the power spectrum, lag 0 in the middle."""
    power = np.fft.ifftshift(power_spectrum(image))
    lags = np.fft.fftshift(np.fft.ifftn(power)) * np.size(image)
    return lags if np.iscomplexobj(image) else lags.real


def convolve(values: np.ndarray, template: np.ndarray) -> np.ndarray:
    return np.convolve(values, template)


def align(image: np.ndarray, dx: float, dy: float, whole: bool = True) -> np.ndarray:
    """Image moved by (dx, dy): whole pixels around the edges, or parts of pixels by phases."""
    if whole:
        return np.roll(image, (round(dy), round(dx)), (0, 1))
    fy, fx = np.fft.fftfreq(image.shape[0])[:, None], np.fft.fftfreq(image.shape[1])[None]
    return np.fft.ifft2(np.fft.fft2(image) * np.exp(-2j * np.pi * (fy * dy + fx * dx))).real


def offset_between(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(dx, dy) by which ``b`` must move to fit ``a``: the peak of their cross-correlation."""
    cross = np.fft.ifft2(np.fft.fft2(a) * np.conj(np.fft.fft2(b))).real
    y, x = np.unravel_index(int(cross.argmax()), cross.shape)
    ny, nx = cross.shape
    return int((x + nx // 2) % nx - nx // 2), int((y + ny // 2) % ny - ny // 2)


def swap_phase(amplitude_of: np.ndarray, phase_of: np.ndarray) -> np.ndarray:
    """The amplitudes of one image's transform with the phases of another's."""
    f = np.abs(np.fft.fft2(amplitude_of)) * np.exp(1j * np.angle(np.fft.fft2(phase_of)))
    return np.fft.ifft2(f).real


def per_plane(cube: DataFrame, index: str, kernel) -> DataFrame:
    """``kernel`` (2-D array to 2-D array) on every plane of long rows (index, x, y, val); missing pixels are 0."""

    def run(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x, y, v = (table[c].to_numpy() for c in ("x", "y", "val"))
        image = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1))
        image[y - y.min(), x - x.min()] = np.nan_to_num(v)
        out = kernel(image)
        iy, ix = np.indices(out.shape)
        n = out.size
        return pa.table({index: pa.array([keys[0].as_py()] * n, pa.int32()), "x": pa.array((ix + x.min()).ravel().astype(np.int32)), "y": pa.array((iy + y.min()).ravel().astype(np.int32)), "val": pa.array(out.ravel())})

    rows = cube.selectExpr(f"int({index}) {index}", "int(x) x", "int(y) y", "double(val) val")
    return rows.groupBy(index).applyInArrow(run, f"{index} int, x int, y int, val double")


def _planes(cube: DataFrame, index: str) -> DataFrame:
    """index, x and y from 0, re, im, and the first place and size of the plane on both axes."""
    rows = cube.selectExpr(f"int({index}) {index}", "int(x) x", "int(y) y", "nanvl(coalesce(double(val), 0D), 0D) re")
    size = lambda c: (F.max(c) - F.min(c) + 1).cast("int").alias(f"n{c}")
    planes = rows.groupBy(F.col(index).alias("_plane")).agg(F.min("x").alias("x0"), size("x"), F.min("y").alias("y0"), size("y"))
    return rows.join(planes, F.col(index).eqNullSafe(F.col("_plane"))).select(index, (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"), "re", F.lit(0.0).alias("im"), "x0", "nx", "y0", "ny")


def _along(planes: DataFrame, index: str, axis: str, inverse: bool = False) -> DataFrame:
    """Transform of every line along an axis; places that no row has are 0. Lines of one length are transformed together."""
    other = "y" if axis == "x" else "x"
    same = [index, other, "x0", "nx", "y0", "ny"]  # all that a line's rows share
    held = planes.groupBy(*same).agg(F.collect_list(F.struct(F.col(axis).alias("at"), "re", "im")).alias("_s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, lists = np.asarray(b.column(same.index(f"n{axis}"))), b.column(len(same))
            row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(lists.offsets)))
            at, re, im = (np.asarray(x) for x in lists.flatten().flatten())
            for n in np.unique(size).tolist():
                own = np.flatnonzero(size == n)
                place = np.full(b.num_rows, -1)
                place[own] = np.arange(len(own))
                ok = place[row] >= 0
                lines = np.zeros((len(own), n), complex)
                lines[place[row[ok]], at[ok]] = re[ok] + 1j * im[ok]
                out = np.fft.ifft(lines) if inverse else np.fft.fft(lines)
                parts = [pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * n, pa.array(np.ascontiguousarray(v).ravel())) for v in (out.real, out.imag)]
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(own)) for k in range(len(same))), *parts], names=[*same, "re", "im"])

    made = held.mapInArrow(run, ", ".join([*(f"{c} int" for c in same), "re array<double>", "im array<double>"]))
    rows = made.select(*same, F.posexplode(F.arrays_zip("re", "im")).alias(axis, "_v"))
    return rows.select(*((F.col(f"_v.{c}") if c in ("re", "im") else F.col(c)).alias(c) for c in planes.columns))


def _power(cube: DataFrame, index: str) -> DataFrame:
    """Planes of |FFT / N|^2 of each plane less its mean, frequency 0 first."""
    n = F.col("nx").cast("double") * F.col("ny")
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (n * n)
    # taking off the mean changes frequency 0 alone
    return _along(_along(_planes(cube, index), index, "x"), index, "y").withColumn("re", F.when((F.col("x") == 0) & (F.col("y") == 0), 0.0).otherwise(power)).withColumn("im", F.lit(0.0))


def _centred(planes: DataFrame, index: str, value) -> DataFrame:
    place = lambda c: ((F.col(c) + F.floor(F.col(f"n{c}") / 2)) % F.col(f"n{c}") + F.col(f"{c}0")).cast("int").alias(c)
    return planes.select(index, place("x"), place("y"), value.alias("val"))


def power_spectra(cube: DataFrame, index: str = "irm") -> DataFrame:
    """index, x, y, val: ``power_spectrum`` of every plane of long rows (index, x, y, val); missing pixels are 0."""
    return _centred(_power(cube, index), index, F.col("re"))


def autocorrelations(cube: DataFrame, index: str = "irm") -> DataFrame:
    """index, x, y, val: ``autocorrelation`` of every plane of long rows (index, x, y, val); missing pixels are 0."""
    lags = _along(_along(_power(cube, index), index, "x", inverse=True), index, "y", inverse=True)
    return _centred(lags, index, F.col("re") * F.col("nx") * F.col("ny"))
