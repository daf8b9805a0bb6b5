"""Channel and Faraday-depth axes, templates, and their DataFrames. All sizes here are those of axes, not of data."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Speed of light in 10^6 m/s, so that frequencies are in MHz.
C_MHZ = 299.792458


def linspace(beg: float, end: float, n: int) -> np.ndarray:
    """``n`` even steps from ``beg`` to ``end``; n < 1 counts as 100, and n = 1 gives ``end``."""
    n = 100 if n < 1 else n
    return np.array([float(end)]) if n == 1 else beg + (end - beg) / (n - 1) * np.arange(n)


def frequency_unit(crval: float) -> float:
    """Factor from the header's unit to MHz: values in [30, 1e4] are MHz, in [30e6, 10e9] Hz; others are an error."""
    if 30 <= crval <= 1e4:
        return 1.0
    if 30e6 <= crval <= 10e9:
        return 1e-6
    raise ValueError(f"can't tell the unit of the frequency {crval}")


def channel_frequencies(crval: float, crpix: float, cdelt: float, n: int, precision: str = "float64") -> np.ndarray:
    """Frequencies in MHz of channels 1 to ``n``; the reference pixel is truncated to an integer, and 0 counts as 1."""
    first = crval - (max(1, int(crpix)) - 1) * cdelt
    freq = (first + cdelt * np.arange(n)).astype(precision).astype(np.float64)
    return freq * frequency_unit(crval)


def lambda_squared(freq_mhz: np.ndarray) -> np.ndarray:
    return (C_MHZ / np.asarray(freq_mhz, np.float64)) ** 2


def rm_resolution(freq_hz: float, bandwidth_hz: float, n: int, c: float = 3e8) -> tuple[float, float]:
    """(resolution, span) in rad/m^2 of ``n`` channels."""
    step = math.pi * freq_hz**3 / (2 * c**2 * bandwidth_hz)
    return step, step * n


def auto_rm_range(freq_mhz: np.ndarray, fac: float = math.pi, compat: bool = False) -> tuple[float, float]:
    """(first, last) depth for one depth a channel; ``compat``: in the order that the channel order implies."""
    f = np.asarray(freq_mhz, np.float64)[::-1] if compat else np.sort(np.asarray(freq_mhz, np.float64))
    step = (f[-1] - f[0]) / (len(f) - 1)
    span = (C_MHZ / (f[0] - step / 2)) ** 2 - (C_MHZ / (f[-1] + step / 2)) ** 2
    half = 0.5 * (len(f) - 1) * fac / span
    return -half, half


def rm_axis(beg: float, end: float, n: int) -> np.ndarray:
    """``n`` depths. A range over 0 gets an exact 0 and one step that fits both sides, so it may end before a far end."""
    if n <= 1:
        return np.array([float(beg)])
    if n >= 3 and beg < 0 < end:
        below = min(max(math.floor((n - 1) * (-beg / (end - beg)) + 0.5), 1), n - 2)
        step = min(-beg / below, end / (n - 1 - below))
        return (np.arange(n) - below) * step
    return beg + (end - beg) / (n - 1) * np.arange(n)


def templates(rm: np.ndarray, lsq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """cos and sin of 2 rm lambda^2, (depth, channel)."""
    phase = 2 * np.outer(rm, lsq)
    return np.cos(phase), np.sin(phase)


@dataclass(frozen=True)
class Axes:
    """What a transform needs to know of its cube: wavelengths squared by channel, depths, and good channels."""

    lsq: np.ndarray
    rm: np.ndarray
    good: np.ndarray

    @classmethod
    def of(cls, freq_mhz: np.ndarray, rm: np.ndarray, bad_channels: list[int] = ()) -> Axes:
        """``bad_channels`` count from 1; those beyond the axis are ignored."""
        good = np.ones(len(freq_mhz), bool)
        good[[c - 1 for c in bad_channels if 0 < c <= len(good)]] = False
        return cls(lambda_squared(freq_mhz), np.asarray(rm, np.float64), good)

    def channels(self, spark: SparkSession) -> DataFrame:
        """chan, freq, lsq, flag; chan counts from 0."""
        rows = [(k, C_MHZ / math.sqrt(x), float(x), int(g)) for k, (x, g) in enumerate(zip(self.lsq, self.good, strict=True))]
        return spark.createDataFrame(rows, "chan int, freq double, lsq double, flag int")

    def depths(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, float(x)) for k, x in enumerate(self.rm)], "irm int, rm double")
