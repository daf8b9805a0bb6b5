"""Dirty beams, CLEAN, restoring, peak interpolation and bandwidth depolarisation of single spectra, as NumPy kernels.

``clean_spectra`` and ``interpolated_peaks`` apply them to all pixels of a DataFrame, batch by batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.axes import C_MHZ, Axes
from .synthesis import Kernel, matrix, rows_of, transform

#: Patterns of weights whose beams a task keeps.
BEAMS = 256


def dirty_beam(axes: Axes, rm0: float = 0.0, phase0: float = 0.0, w: np.ndarray | None = None, stokes: str = "QU", rm: np.ndarray | None = None) -> np.ndarray:
    """Complex response to a unit source at ``rm0`` with angle phase0 (radians); ``stokes`` 'Q' or 'U' for one parameter."""
    w = np.ones(len(axes.lsq)) if w is None else np.asarray(w, np.float64)
    angle = 2 * (phase0 + rm0 * axes.lsq)
    q, u = np.cos(angle) * ("Q" in stokes), np.sin(angle) * ("U" in stokes)
    own = Axes(axes.lsq, axes.rm if rm is None else rm, axes.good)
    re, im, _ = transform(q[None], u[None], w[None], own)
    return re[0] + 1j * im[0]


@dataclass
class Cleaned:
    components: np.ndarray
    residual: np.ndarray
    iterations: int


def wide_beam(axes: Axes, w: np.ndarray | None = None, stokes: str = "QU") -> np.ndarray | None:
    """Responses on the grid of differences, so that a peak's beam is a slice; for one Stokes parameter, whose mirrored
    source answers too, those on the grid of sums follow. A grid that isn't even has none."""
    step, k = np.diff(axes.rm), len(axes.rm) - 1
    if not len(step) or not np.allclose(step, step[0]):
        return None
    near = step[0] * np.arange(-k, k + 1)
    return dirty_beam(axes, w=w, rm=near if stokes == "QU" else np.concatenate([near, 2 * axes.rm[0] + step[0] * np.arange(2 * k + 1)]))


def _answers(axes: Axes, at: np.ndarray, peak: np.ndarray, w: np.ndarray, wide: np.ndarray | None, stokes: str) -> np.ndarray:
    """Each pixel's response to its peak. ``wide``: a row a pixel, or None for a transform of all of them."""
    n = len(axes.rm)
    if wide is None:
        angle = np.angle(peak)[:, None] + 2 * axes.rm[at][:, None] * axes.lsq
        re, im, _ = transform(np.cos(angle) * ("Q" in stokes), np.sin(angle) * ("U" in stokes), w, axes)
        return np.abs(peak)[:, None] * (re + 1j * im)
    own = np.take_along_axis(wide, (n - 1 - at)[:, None] + np.arange(n), 1) * peak[:, None]
    if stokes == "QU":
        return own
    # cos and sin are half the sum and the difference of a source and its mirror image
    mirror = np.take_along_axis(wide, 2 * n - 1 + at[:, None] + np.arange(n), 1) * peak.conj()[:, None]
    return (own + mirror if stokes == "Q" else own - mirror) / 2


def clean_all(spectra: np.ndarray, axes: Axes, w: np.ndarray, gain: float = 0.1, threshold: float = 3.0, niter: int = 1000, stokes: str = "QU", wide: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components, residuals, iterations) of (pixel, depth) spectra with (pixel, channel) weights, all pixels at once.

    An iteration takes gain times the beam at each residual's peak off; pixels whose peak is within threshold rms of the
    mean leave the set that is worked on. ``wide``: beams of patterns and each pixel's pattern, if they are known.
    """
    residual, parts = np.array(spectra, complex), np.zeros(spectra.shape, complex)
    done = np.zeros(len(residual), np.int32)
    active = np.flatnonzero(np.isfinite(residual).all(1))
    for _ in range(niter):
        rest = residual[active]
        size = np.abs(rest)
        at = size.argmax(1)
        top = size[np.arange(len(at)), at]
        go = np.abs(top - size.mean(1)) > threshold * size.std(1)
        active, at, rest = active[go], at[go], rest[go]
        if not len(active):
            break
        peak = gain * rest[np.arange(len(at)), at]
        residual[active] = rest - _answers(axes, at, peak, w[active], None if wide is None else wide[0][wide[1][active]], stokes)
        parts[active, at] += peak
        done[active] += 1
    return parts, residual, done


def clean(spectrum: np.ndarray, axes: Axes, w: np.ndarray | None = None, gain: float = 0.1, threshold: float = 3.0, niter: int = 1000, stokes: str = "QU", wide: np.ndarray | None = None) -> Cleaned:
    """``clean_all`` of one spectrum. ``wide``: the beam of ``wide_beam``, if it is known."""
    wide = wide_beam(axes, w, stokes) if wide is None else wide
    w = np.ones(len(axes.lsq)) if w is None else np.asarray(w, np.float64)
    parts, residual, n = clean_all(np.asarray(spectrum)[None], axes, w[None], gain, threshold, niter, stokes, None if wide is None else (wide[None], np.zeros(1, int)))
    return Cleaned(parts[0], residual[0], int(n[0]))


def restore(components: np.ndarray, fwhm_bins: float | np.ndarray, compat: bool = False) -> np.ndarray:
    """Components (rows of them, each with its width) convolved with a Gaussian of height 1 by FFT; ``compat`` halves its standard deviation."""
    n = components.shape[-1]
    sigma = np.asarray(fwhm_bins, np.float64)[..., None] * 0.42466 * (0.5 if compat else 1.0)
    size = 1 << (2 * n - 1).bit_length()
    d = np.minimum(np.arange(size), size - np.arange(size))
    beam = np.exp(-0.5 * (d / sigma) ** 2)
    return np.fft.ifft(np.fft.fft(components, size) * np.fft.fft(beam))[..., :n]


def beam_width(beam: np.ndarray) -> float:
    """Full width at half maximum of a beam's main lobe, in bins."""
    size = np.abs(beam)
    at = int(size.argmax())
    half = size[at] / 2
    edges = []
    for step in (-1, 1):
        k = at
        while 0 <= k + step < len(size) and size[k + step] > half:
            k += step
        far = k + step
        edges.append(k + step * ((size[k] - half) / (size[k] - size[far])) if 0 <= far < len(size) else float(k))
    return edges[1] - edges[0]


def _cleaned(df: DataFrame, axes: Axes, names: str, give, gain: float, threshold: float, niter: int, stokes: str) -> DataFrame:
    """``give`` (components, residual, width in bins) makes the arrays of a batch; x, y before them, iterations after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel, known = Kernel(axes), {}  # a pattern of weights: its beams, and their width
        for b in batches:
            if not b.num_rows:
                continue
            q, u, w = (matrix(b.column(k)) for k in (2, 3, 4))
            re, im, _ = kernel(q * ("Q" in stokes), u * ("U" in stokes), w)
            patterns, of = np.unique(w, axis=0, return_inverse=True)
            if len(known) > BEAMS:
                known.clear()
            for p in patterns:
                if p.tobytes() not in known:
                    known[p.tobytes()] = wide_beam(axes, p, stokes), beam_width(dirty_beam(axes, axes.rm[len(axes.rm) // 2], w=p, stokes=stokes))
            wides, widths = zip(*(known[p.tobytes()] for p in patterns), strict=True)
            wide = None if wides[0] is None else (np.array(wides), of.ravel())
            parts, residual, n = clean_all(re + 1j * im, axes, w, gain, threshold, niter, stokes, wide)
            out = [x for a in give(parts, residual, np.array(widths)[of.ravel()]) for x in (a.real, a.imag)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(rows_of(x, pa.float64()) for x in out), pa.array(n, pa.int32())], names=["x", "y", *names.split(", "), "iterations"])

    return df.select("x", "y", "q", "u", "w").mapInArrow(run, f"x int, y int, {', '.join(f'{n} array<double>' for n in names.split(', '))}, iterations int")


def clean_spectra(df: DataFrame, axes: Axes, gain: float = 0.1, threshold: float = 3.0, niter: int = 1000, fwhm_bins: float | None = None, compat: bool = False, stokes: str = "QU") -> DataFrame:
    """x, y, re, im, iterations: synthesised, cleaned and restored spectra of pixels with arrays q, u, w by channel.

    ``stokes`` 'Q' or 'U' takes one parameter alone. All pixels of a batch are worked on at once; beams and their widths are made once for each pattern of weights.
    """
    return _cleaned(df, axes, "re, im", lambda parts, residual, width: [restore(parts, np.full(len(width), fwhm_bins) if fwhm_bins else width, compat) + residual], gain, threshold, niter, stokes)


def clean_components(df: DataFrame, axes: Axes, gain: float = 0.1, threshold: float = 3.0, niter: int = 1000, stokes: str = "QU") -> DataFrame:
    """x, y, component_re, component_im, re, im (of the residual), iterations: what ``clean_spectra`` restores."""
    return _cleaned(df, axes, "component_re, component_im, re, im", lambda parts, residual, width: [parts, residual], gain, threshold, niter, stokes)


def depolarisation_corrected(df: DataFrame, axes: Axes, width_mhz: float, order: int = 3, index: float = -1.5) -> DataFrame:
    """x, y, re, im by depth, divided by the loss that channels of finite width cause at each depth."""
    freq = C_MHZ / np.sqrt(axes.lsq[axes.good])
    loss = depolarisation_weight(axes.rm, freq, width_mhz, order, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                whole = (matrix(b.column(2)) + 1j * matrix(b.column(3))) / loss
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), rows_of(whole.real, pa.float64()), rows_of(whole.imag, pa.float64())], names=["x", "y", "re", "im"])

    return df.select("x", "y", "re", "im").mapInArrow(run, "x int, y int, re array<double>, im array<double>")


def phase_of_components(values: np.ndarray, lsq: np.ndarray, rm: float) -> float:
    """Phase from the least-squares share of the cosine and the sine at a depth."""
    a, b = np.linalg.lstsq(np.column_stack([np.cos(2 * rm * lsq), np.sin(2 * rm * lsq)]), values, rcond=None)[0]
    return math.atan2(b, a)


def profile_noise(profile: np.ndarray, beam: np.ndarray, first: int = 100) -> float:
    """rms of the first bins after the peak's beam (unit peak) is taken off."""
    return float(np.std((profile - np.max(np.abs(profile)) * beam)[:first]))


def component_phases(samples: DataFrame, value: str, rm: float, by: list[str] = ("x", "y")) -> DataFrame:
    """by, phase: ``phase_of_components`` of each group of long samples (``value``, lsq, w), from five sums."""
    angle = 2 * rm * F.col("lsq")
    v, c, s, w = F.col(value), F.cos(angle), F.sin(angle), F.col("w")
    sums = samples.groupBy(*by).agg(*(F.sum(w * x).alias(n) for n, x in (("cc", c * c), ("ss", s * s), ("cs", c * s), ("vc", v * c), ("vs", v * s))))
    a, b = F.col("vc") * F.col("ss") - F.col("vs") * F.col("cs"), F.col("vs") * F.col("cc") - F.col("vc") * F.col("cs")
    return sums.select(*by, F.when(F.col("cc") * F.col("ss") > F.col("cs") * F.col("cs"), F.atan2(b, a)).alias("phase"))


def profile_noises(profiles: DataFrame, beam: DataFrame, column: str = "amp", first: int = 100, by: list[str] = ("x", "y")) -> DataFrame:
    """by, rms: ``profile_noise`` of each group of long profiles (irm, ``column``). ``beam`` (irm, beam) is an axis."""
    peaks = profiles.groupBy(*by).agg(F.max(F.abs(column)).alias("_peak"))
    left = profiles.where(F.col("irm") < first).join(F.broadcast(beam), "irm").join(peaks, [*by])
    return left.groupBy(*by).agg(F.stddev_pop(F.col(column) - F.col("_peak") * F.col("beam")).alias("rms"))


# -- peak interpolation: (place in bins, complex or real value there)


def _near(size: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    return size[np.arange(len(at)), np.clip(at + step, 0, size.shape[1] - 1)]


def quadratic_peaks(size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parabolas through the logarithms of three amplitudes of each row; the values are those at the vertices."""
    low, mid, high = (_near(size, at, k) for k in (-1, 0, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b, c = np.log10(low), np.log10(mid), np.log10(high)
        bend = a - 2 * b + c
        off = np.where(bend != 0, 0.5 * (a - c) / bend, 0.0)
        value = 10 ** (b - 0.25 * (a - c) * off)
    ok = (at > 0) & (at < size.shape[1] - 1) & (low > 0) & (mid > 0) & (high > 0)
    return np.where(ok, at + off, at), np.where(ok, value, mid)


def _zoomed(values: np.ndarray, at: np.ndarray, factor: int) -> np.ndarray:
    """Fourier interpolation of rows at ``factor`` places a bin, from a bin before ``at`` to one after, by a product with
    the waves of those places; the middle frequency is shared by both halves."""
    n = values.shape[1]
    spec, f = np.fft.fft(values) / n, np.fft.fftfreq(n, 1 / n)
    if n % 2 == 0:
        spec[:, n // 2] /= 2
        spec, f = np.concatenate([spec, spec[:, n // 2, None]], 1), np.append(f, n / 2)
    waves = np.exp(2j * np.pi / n * np.outer(f, np.arange(-factor, factor + 1) / factor))
    return (spec * np.exp(2j * np.pi / n * np.outer(at, f))) @ waves


def interpolated(spectra: np.ndarray, method: int = 1, factor: int = 16, reach: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(places, amplitudes) of the peaks of rows. 1: quadratic in log amplitude, 2: Fourier of the amplitude, 3: Fourier of
    the complex spectrum, 4: sinc within ``reach`` bins; any other number: quadratic."""
    size = np.abs(spectra)
    at, rows, n = size.argmax(1), np.arange(len(size)), size.shape[1]
    if method not in (2, 3, 4):
        return quadratic_peaks(size, at)
    places = at[:, None] + np.arange(-factor, factor + 1) / factor
    if method == 4:
        near = at[:, None] + np.arange(-reach, reach + 1)
        own = np.where((near >= 0) & (near < n), np.take_along_axis(spectra, np.clip(near, 0, n - 1), 1), 0)
        values = np.abs(own @ np.sinc(np.arange(-reach, reach + 1)[:, None] - np.arange(-factor, factor + 1) / factor))
    else:
        values = np.abs(_zoomed(size if method == 2 else spectra, at, factor))
        values = np.where((places >= 0) & (places * factor < n * factor), values, -1)
    k = values.argmax(1)
    return places[rows, k], values[rows, k]


def interpolated_peak(spectrum: np.ndarray, method: int = 1, factor: int = 16, reach: int = 8) -> tuple[float, float]:
    """``interpolated`` of one spectrum."""
    place, value = interpolated(np.asarray(spectrum)[None], method, factor, reach)
    return float(place[0]), float(value[0])


def interpolated_peaks(df: DataFrame, rm: np.ndarray, method: int = 1) -> DataFrame:
    """x, y, rm_peak, peak between the grid's depths, from arrays re and im by depth; nulls where a spectrum isn't finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                spectra = matrix(b.column(2)) + 1j * matrix(b.column(3))
                ok = np.isfinite(spectra).all(1)
                place, value = interpolated(np.where(ok[:, None], spectra, 0), method)
                depth = np.interp(place, np.arange(len(rm)), rm)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(depth, mask=~ok), pa.array(value, mask=~ok)], names=["x", "y", "rm_peak", "peak"])

    return df.select("x", "y", "re", "im").mapInArrow(run, "x int, y int, rm_peak double, peak double")


def depolarisation_weight(rm: np.ndarray, freq_mhz: np.ndarray, width_mhz: float, order: int = 3, index: float = -1.5) -> np.ndarray:
    """Complex loss of channels of finite width at each depth, averaged over channels with weight nu^index, 1 at depth 0.

    The mean over a channel of exp(2 i rm (lambda^2 - lambda0^2)) by a Taylor series of the phase in frequency to
    ``order`` (1 to 3): the phase is a polynomial of the offset, averaged on Gauss-Legendre nodes.
    """
    f = np.asarray(freq_mhz, np.float64)
    nodes, weights = np.polynomial.legendre.leggauss(32)
    d = nodes * width_mhz / 2
    lsq = (C_MHZ / f) ** 2
    x = d[None, :] / f[:, None]
    series = lsq[:, None] * sum((-1) ** k * (k + 1) * x**k for k in range(1, order + 1))
    share = f**index / (f**index).sum()
    loss = np.array([share @ (np.exp(2j * r * series) @ weights / 2) for r in np.atleast_1d(rm)])
    return loss
