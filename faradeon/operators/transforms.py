"""Fourier transforms of complex lines and planes in DataFrames, and what follows from them: alignment, convolution.

A line is the rows of a group: an index from 0 and a complex value. Lines are gathered into arrays and many of them are
transformed at once, a batch a product. A line of more than ``LINE`` points is split in four steps: with n = n1 * n2, n2 lines of n1
points (every n2-th), twiddle factors, and n1 lines of n2 points, so that no task holds a whole line. Planes are lines
along one axis, then along the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of a line that one task transforms.
LINE = 1 << 16

_PAIRS = "array<double>"


def _gathered(df: DataFrame, by: list[str], index: Column, n: int, re: Column, im: Column) -> DataFrame:
    """by, re, im: arrays of ``n`` points by index; points that a line lacks are 0."""
    held = F.map_from_entries(F.collect_list(F.struct(index.cast("int"), F.struct(re.cast("double").alias("re"), im.cast("double").alias("im")))))
    lines = df.groupBy(*by).agg(held.alias("_m"))
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at("_m", k), F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))))
    return lines.select(*by, at.alias("_v")).select(*by, F.col("_v.re").alias("re"), F.col("_v.im").alias("im"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)


def _transformed(lines: DataFrame, inverse: bool, twiddle: tuple[str, int] | None = None) -> DataFrame:
    """Arrays re and im of all lines transformed; ``twiddle``: (column j, n) multiplies point k by exp(-+ 2 pi i j k / n)."""
    names, at = lines.columns, lines.columns.index(twiddle[0]) if twiddle else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column(len(names) - 2)) + 1j * _matrix(b.column(len(names) - 1))
            out = np.fft.ifft(v) * v.shape[1] if inverse else np.fft.fft(v)
            if twiddle:
                j = np.asarray(b.column(at), np.float64)[:, None]
                out *= np.exp((2j if inverse else -2j) * np.pi * (j * np.arange(v.shape[1]) % twiddle[1]) / twiddle[1])
            offsets = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
            parts = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x).ravel())) for x in (out.real, out.imag)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(names) - 2)), *parts], names=names)

    return lines.mapInArrow(run, lines.schema)


def _rows(lines: DataFrame, by: list[str], index: str) -> DataFrame:
    return lines.select(*by, F.posexplode(F.arrays_zip("re", "im")).alias(index, "_v")).select(*by, index, F.col("_v.re").alias("re"), F.col("_v.im").alias("im"))


def factors(n: int, most: int) -> tuple[int, int]:
    """n1 * n2 = n with both at most ``most``, n1 the larger and as small as can be; an ``n`` without such factors is an error."""
    for n2 in range(math.isqrt(n), 0, -1):
        if n % n2 == 0:
            if n // n2 > most:
                break
            return n // n2, n2
    raise ValueError(f"{n} has no two factors of at most {most}; pad the lines")


def fourier(df: DataFrame, by: list[str], index: str, n: int, re: str = "re", im: str | None = "im", inverse: bool = False, line: int = LINE) -> DataFrame:
    """by, index, re, im: the transform of lines of ``n`` points; the inverse divides by ``n``.

    ``df``: by, index (from 0), re and, unless ``im`` is None, im. Points that a line lacks count as 0, points beyond
    0 to n - 1 are left out; a point that comes twice is an error. Null values count as 0.
    """
    value = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c else F.lit(0.0)
    rows = df.where(F.col(index).between(0, n - 1)).select(*by, F.col(index).cast("int").alias("_k"), value(re).alias("_re"), value(im).alias("_im"))
    if n <= line:
        out = _rows(_transformed(_gathered(rows, by, F.col("_k"), n, F.col("_re"), F.col("_im")), inverse), by, index)
    else:
        n1, n2 = factors(n, line)
        # point k = n2 * k1 + k2; frequency f = f1 + n1 * f2
        parts = rows.withColumn("_j", F.col("_k") % n2)
        first = _transformed(_gathered(parts, [*by, "_j"], F.floor(F.col("_k") / n2), n1, F.col("_re"), F.col("_im")), inverse, ("_j", n))
        turned = _rows(first, [*by, "_j"], "_f1")
        second = _rows(_transformed(_gathered(turned, [*by, "_f1"], F.col("_j"), n2, F.col("re"), F.col("im")), inverse), [*by, "_f1"], "_f2")
        out = second.select(*by, (F.col("_f1") + n1 * F.col("_f2")).cast("int").alias(index), "re", "im")
    scale = 1.0 / n if inverse else 1.0
    return out.select(*by, index, *((F.col(c) * scale).alias(c) for c in ("re", "im")))


def fourier_2d(df: DataFrame, by: list[str], nx: int, ny: int, re: str = "re", im: str | None = "im", inverse: bool = False, line: int = LINE) -> DataFrame:
    """by, x, y, re, im: the transform of planes of nx by ny points, x and y from 0; lines along x, then along y."""
    along_x = fourier(df, [*by, "y"], "x", nx, re, im, inverse, line)
    return fourier(along_x, [*by, "x"], "y", ny, "re", "im", inverse, line).select(*by, "x", "y", "re", "im")


def offsets(a: DataFrame, b: DataFrame, by: list[str], nx: int, ny: int, value: str = "val", line: int = LINE) -> DataFrame:
    """by, dx, dy: by how much each plane of ``b`` must move to fit that of ``a``: the peak of their cross-correlation.

    Spectra are joined frequency by frequency; of equal peaks the one with the least y, then the least x counts.
    """
    fa, fb = (fourier_2d(df.select(*by, "x", "y", value), by, nx, ny, value, None, line=line) for df in (a, b))
    other = fb.select(*by, "x", "y", F.col("re").alias("_re"), F.col("im").alias("_im"))
    cross = fa.join(other, [*by, "x", "y"]).select(*by, "x", "y", (F.col("re") * F.col("_re") + F.col("im") * F.col("_im")).alias("re"), (F.col("im") * F.col("_re") - F.col("re") * F.col("_im")).alias("im"))
    lags = fourier_2d(cross, by, nx, ny, inverse=True, line=line)
    peak = lags.groupBy(*by).agg(F.max_by(F.struct("x", "y"), F.struct("re", -F.col("y"), -F.col("x"))).alias("p"))
    signed = lambda c, n: (F.pmod(F.col(c) + n // 2, F.lit(n)) - n // 2).cast("int")
    return peak.select(*by, signed("p.x", nx).alias("dx"), signed("p.y", ny).alias("dy"))


def moved(df: DataFrame, shifts: DataFrame, by: list[str], nx: int, ny: int, value: str = "val", line: int = LINE) -> DataFrame:
    """by, x, y, ``value`` of planes moved by their dx, dy in ``shifts``, parts of pixels by phase ramps in the frequency domain.

    The middle frequency of an even size has no partner, so it keeps its real share alone.
    """
    f = fourier_2d(df.select(*by, "x", "y", value), by, nx, ny, value, None, line=line).join(shifts.select(*by, "dx", "dy"), by)
    wave = lambda c, n: F.when(2 * F.col(c) <= n, F.col(c)).otherwise(F.col(c) - n) / n
    p = -2 * math.pi * (wave("x", nx) * F.col("dx") + wave("y", ny) * F.col("dy"))
    turned = f.select(*by, "x", "y", (F.col("re") * F.cos(p) - F.col("im") * F.sin(p)).alias("re"), (F.col("re") * F.sin(p) + F.col("im") * F.cos(p)).alias("im"))
    return fourier_2d(turned, by, nx, ny, inverse=True, line=line).select(*by, "x", "y", F.col("re").alias(value))


def convolved(df: DataFrame, by: list[str], index: str, value: str, template: list[float], mirror: bool = False, block: int = LINE) -> DataFrame:
    """by, index, ``value``: series convolved with a short template, as long as a series and the template less one.

    Series are cut into ranges of ``block`` places. A range of the result needs the values of its own places and as
    many before them as the template is long less one, its halo, which are sent to both ranges; so a series is as many tasks as it has ranges. Places
    that a series lacks count as 0; results are given from the series' first place to its last and the template's length beyond.
    ``mirror``: with the template turned around. Nulls count as 0, and a place that comes twice is an error.
    """
    t = np.asarray(template[::-1] if mirror else template, np.float64)
    if not len(t):
        raise ValueError("the template is empty")
    if len(t) > block:
        raise ValueError(f"a template of {len(t)} values needs ranges of {len(t)} places at least")
    halo, k = len(t) - 1, F.col("_k")
    rows = df.select(*by, F.col(index).cast("long").alias("_k"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_v"))
    own = F.floor(k / block)
    last = F.floor((k + halo) / block)
    sent = rows.select(*by, "_k", "_v", F.explode(F.when(own == last, F.array(own)).otherwise(F.array(own, last))).alias("_r"))
    held = sent.groupBy(*by, "_r").agg(F.sort_array(F.collect_list(F.struct("_k", "_v"))).alias("_s"))
    n_by = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, values, rows_ = [], [], []
            for j in range(b.num_rows):
                first = b.column(n_by)[j].as_py() * block
                s = b.column(n_by + 1)[j].values.flatten()
                at, v = np.asarray(s[0], np.int64), np.asarray(s[1], np.float64)
                if len(np.unique(at)) < len(at):
                    raise ValueError("a place comes twice")
                line = np.zeros(block + halo)  # from the halo on
                line[at - first + halo] = v
                out = np.convolve(line, t)[halo : halo + block]
                # only places that the series reaches
                reach = np.zeros(block + halo + 1, np.int64)
                np.add.at(reach, np.clip(at - first + halo, 0, block + halo), 1)
                np.add.at(reach, np.clip(at - first + halo + len(t), 0, block + halo), -1)
                ok = np.cumsum(reach)[halo : halo + block] > 0
                places.append(first + np.flatnonzero(ok))
                values.append(out[ok])
                rows_.append(np.full(int(ok.sum()), j))
            if places:
                take = pa.array(np.concatenate(rows_))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in range(n_by)), pa.array(np.concatenate(places)), pa.array(np.concatenate(values))], names=[*by, index, value])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return held.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), f"`{index}` long", f"`{value}` double"]))
