"""Faraday synthesis: relational form, Arrow form, mean removal, output modes.

Relational: one row a sample and depth, partial sums before the shuffle; for SQL users, few depths, or samples
that come late. Arrow: spectra as arrays, a matrix product a batch, no shuffle; the default for whole cubes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.axes import Axes, templates

#: Depths of one matrix product, and bytes of spectra in a batch; they bound a worker's memory.
DEPTH_BLOCK = 256
BATCH_BYTES = 16 << 20


def mean_removed(df: DataFrame) -> DataFrame:
    """q and u less their weighted means over the pixel's good samples; bad samples become 0."""
    means = df.groupBy("x", "y").agg(*(F.coalesce(F.sum(F.col("w") * F.col(c)) / F.nullif(F.sum("w"), F.lit(0)), F.lit(0.0)).alias(f"_{c}") for c in ("q", "u")))
    out = df.join(means, ["x", "y"])
    return out.select(*(((F.col(c) - F.col(f"_{c}")) * F.col("w")).alias(c) if c in ("q", "u") else F.col(c) for c in df.columns))


def relational(df: DataFrame, channels: DataFrame, depths: DataFrame) -> DataFrame:
    """x, y, irm, rm, re, im, w from long samples (x, y, chan, q, u, w); null re and im where no sample is good.

    ``channels`` (chan, lsq) and ``depths`` (irm, rm) are axes, so they are broadcast.
    """
    wide = df.join(F.broadcast(channels.select("chan", "lsq")), "chan").crossJoin(F.broadcast(depths.select("irm", "rm")))
    p = 2 * F.col("rm") * F.col("lsq")
    w = F.nullif(F.sum("w"), F.lit(0))
    re = F.sum(F.col("w") * (F.col("q") * F.cos(p) + F.col("u") * F.sin(p))) / w
    im = F.sum(F.col("w") * (F.col("u") * F.cos(p) - F.col("q") * F.sin(p))) / w
    return wide.groupBy("x", "y", "irm", "rm").agg(re.alias("re"), im.alias("im"), F.sum("w").cast("int").alias("w"))


def spectra(df: DataFrame, n_chan: int) -> DataFrame:
    """x, y, q, u, w arrays by channel from long samples; a channel that a pixel lacks has weight 0."""
    rows = df.groupBy("x", "y").agg(F.map_from_entries(F.collect_list(F.struct("chan", F.struct("q", "u", F.col("w").cast("int").alias("w"))))).alias("m"))
    at = F.transform(F.sequence(F.lit(0), F.lit(n_chan - 1)), lambda k: F.coalesce(F.try_element_at("m", k.cast("int")), F.struct(F.lit(0.0).alias("q"), F.lit(0.0).alias("u"), F.lit(0).alias("w"))))
    return rows.select("x", "y", at.alias("s")).select("x", "y", F.col("s.q").alias("q"), F.col("s.u").alias("u"), F.col("s.w").alias("w"))


class Kernel:
    """The transform of one run's axes: templates are built once, and masked samples take no part.

    A block of depths is one matrix product, [q u] by [[c, -s], [s, c]], in ``dtype``. Templates are computed in doubles.
    """

    def __init__(self, axes: Axes, dtype: type = np.float64):
        self.axes, self.dtype, self.good = axes, dtype, np.flatnonzero(axes.good)
        lsq = np.asarray(axes.lsq)[self.good]
        self.blocks = []
        for a in range(0, len(axes.rm), DEPTH_BLOCK):
            c, s = templates(axes.rm[a : a + DEPTH_BLOCK], lsq)
            self.blocks.append((slice(a, a + len(c)), np.block([[c.T, -s.T], [s.T, c.T]]).astype(dtype)))

    def __call__(self, q: np.ndarray, u: np.ndarray, w: np.ndarray, remove_mean: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(re, im, total weight) of (pixel, channel) arrays; NaN where no sample is good."""
        n = len(self.good)
        w = (w if self.axes.good.all() else w[:, self.good]).astype(self.dtype)
        both = np.empty((len(w), 2 * n), self.dtype)
        for x, part in ((q, both[:, :n]), (u, both[:, n:])):
            part[:] = x if n == x.shape[1] else x[:, self.good]
            part[w <= 0] = 0
        total = w.sum(1, dtype=np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            if remove_mean:
                for part in (both[:, :n], both[:, n:]):
                    mean = np.nan_to_num((w * part).sum(1, dtype=np.float64) / total).astype(self.dtype)
                    part -= mean[:, None]
                    part *= w
            both *= (1 / total).astype(self.dtype)[:, None]
        both[total == 0] = np.nan
        re, im = (np.empty((len(w), len(self.axes.rm)), self.dtype) for _ in range(2))
        for at, m in self.blocks:
            out = both @ m
            re[:, at], im[:, at] = out[:, : m.shape[1] // 2], out[:, m.shape[1] // 2 :]
        return re, im, total


def transform(q: np.ndarray, u: np.ndarray, w: np.ndarray, axes: Axes, remove_mean: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(re, im, total weight) of (pixel, channel) arrays in doubles; NaN where no sample is good. Masked samples count as 0."""
    return Kernel(axes)(q, u, w, remove_mean)


def matrix(column: pa.Array, dtype: type | None = np.float64) -> np.ndarray:
    """Equal-length rows of a list column as a matrix, of doubles unless ``dtype`` says otherwise (None: as it is)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype).reshape(len(column), -1)


def rows_of(values: np.ndarray, kind: pa.DataType = pa.float32()) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(values).ravel(), kind, from_pandas=False)
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], flat)


def bounded_spectra(spark, n_chan: int) -> None:
    """Lower the session's rows of an Arrow batch, if need be, so that a batch of spectra has BATCH_BYTES at most."""
    key, most = "spark.sql.execution.arrow.maxRecordsPerBatch", max(64, BATCH_BYTES // (20 * n_chan))
    now = int(spark.conf.get(key))
    if not 0 < now <= most:
        spark.conf.set(key, str(most))


def synthesise(df: DataFrame, axes: Axes, mode: str = "ap", angle: str = "phase", remove_mean: bool = False, precision: str = "float") -> DataFrame:
    """x, y, then amp and ang (mode 'ap'; angle 'phase' or 'pol') or re and im ('ri') arrays by depth, and nvalid.

    ``df`` has x, y and arrays q, u, w by channel. One pass without a shuffle; templates are built once a task, and a
    batch (BATCH_BYTES of spectra at most) costs one matrix product a block of depths, in ``precision``.
    """
    if mode not in ("ap", "ri") or angle not in ("phase", "pol"):
        raise ValueError(f"unknown mode {mode} or angle {angle}")
    names = ("amp", "ang") if mode == "ap" else ("re", "im")
    kind, dtype = (pa.float32(), np.float32) if precision == "float" else (pa.float64(), np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel(axes, dtype)
        for b in batches:
            if not b.num_rows:
                continue
            q, u, w = (matrix(b.column(k), None) for k in (2, 3, 4))
            re, im, total = kernel(q, u, w, remove_mean)
            first, second = (np.sqrt(re * re + im * im), np.arctan2(im, re) * dtype(0.5 if angle == "pol" else 1)) if mode == "ap" else (re, im)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), rows_of(first, kind), rows_of(second, kind), pa.array(total.astype(np.int32))], names=["x", "y", *names, "nvalid"])

    bounded_spectra(df.sparkSession, len(axes.lsq))
    return df.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "q", "u", "w").mapInArrow(run, f"x int, y int, {names[0]} array<{precision}>, {names[1]} array<{precision}>, nvalid int")


def exploded(faraday: DataFrame, depths: DataFrame) -> DataFrame:
    """One row a pixel and depth from arrays by depth."""
    names = [f.name for f in faraday.schema if isinstance(f.dataType, T.ArrayType)]
    rows = faraday.select("x", "y", F.posexplode(F.arrays_zip(*names)).alias("irm", "v")).select("x", "y", "irm", *(F.col(f"v.{n}").alias(n) for n in names))
    return rows.join(F.broadcast(depths), "irm")
