"""Peak and noise of Faraday spectra."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import lower_median, lower_quantile, nan_to_null
from .synthesis import matrix

FLOOR = 1e-12
#: 0.16 quantile of a normal distribution lies about this many deviations under its median; fixed value.
TAIL = 0.67449
MAD = 1.4826


def first_argmax(what: str, amp: str, index: str) -> Column:
    """``what`` where ``amp`` is largest, ties to the least index; NaN and null amplitudes don't count."""
    return F.max_by(F.col(what), F.when(nan_to_null(amp).isNotNull(), F.struct(F.col(amp), -F.col(index))))


def last_argmax(what: str, amp: str, index: str) -> Column:
    return F.max_by(F.col(what), F.when(nan_to_null(amp).isNotNull(), F.struct(F.col(amp), F.col(index))))


def tail_sigma(amps: Column) -> Column:
    """Noise of an array of amplitudes: (lower median - 0.16 quantile) / 0.67449, else 1.4826 MAD, at least 1e-12."""
    med, low = lower_median(amps), lower_quantile(amps, 0.16)
    tail = (med - low) / TAIL
    mad = lower_median(F.transform(amps, lambda a: F.abs(a - med)))
    return F.greatest(F.when(tail > 0, tail).otherwise(MAD * mad), F.lit(FLOOR))


def peaks(long: DataFrame) -> DataFrame:
    """x, y, peak, rm_peak, ang_peak, snr from long rows (x, y, irm, rm, amp, ang); nulls where nothing is valid."""
    rows = long.groupBy("x", "y").agg(
        F.max(nan_to_null("amp")).alias("peak"), first_argmax("rm", "amp", "irm").alias("rm_peak"), first_argmax("ang", "amp", "irm").alias("ang_peak"), F.collect_list(nan_to_null("amp")).alias("amps")
    )
    return rows.select("x", "y", "peak", "rm_peak", "ang_peak", F.when(F.size("amps") > 0, F.col("peak") / tail_sigma(F.col("amps"))).alias("snr"))


def peak_of(amp: np.ndarray, ang: np.ndarray, rm: np.ndarray) -> tuple[np.ndarray, ...]:
    """(peak, depth, angle, snr) of (pixel, depth) arrays, NaN where nothing is valid."""
    ok = ~np.isnan(amp)
    n = ok.sum(1)
    some = n > 0
    at = np.where(ok, amp, -np.inf).argmax(1)
    rows = np.arange(len(amp))
    s = np.sort(amp, 1)  # NaN comes last
    mid = s[rows, np.maximum((n + 1) // 2 - 1, 0)]
    low = s[rows, np.maximum(np.floor(0.16 * (n - 1)).astype(int), 0)]
    sigma = (mid - low) / TAIL
    weak = some & ~(sigma > 0)
    if weak.any():
        dev = np.sort(np.abs(amp[weak] - mid[weak, None]), 1)
        sigma[weak] = MAD * dev[np.arange(len(dev)), (n[weak] + 1) // 2 - 1]
    sigma = np.maximum(sigma, FLOOR)
    out = amp[rows, at], rm[at], ang[rows, at], amp[rows, at] / sigma
    return tuple(np.where(some, v, np.nan) for v in out)


def peak_maps(faraday: DataFrame, rm: np.ndarray) -> DataFrame:
    """x, y, nvalid, peak, rm_peak, ang_peak, snr from arrays amp and ang by depth; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                maps = peak_of(matrix(b.column(3)), matrix(b.column(4)), rm)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(m, pa.float64(), from_pandas=True) for m in maps)], names=["x", "y", "nvalid", "peak", "rm_peak", "ang_peak", "snr"])

    return faraday.select("x", "y", "nvalid", "amp", "ang").mapInArrow(run, "x int, y int, nvalid int, peak double, rm_peak double, ang_peak double, snr double")
