"""Test cubes: point sources with noise, extended sources with a spectral index, and a run log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from .axes import lambda_squared


@dataclass(frozen=True)
class Source:
    x: float
    y: float
    rm: float
    p0: float
    chi0: float = 0.0  # radians
    fwhm: float = 0.0  # pixels; 0 is a point
    i0: float = 0.0
    index: float = 0.0


def cube(nx: int, ny: int, freq_mhz: np.ndarray, sources: Sequence[Source], noise: float = 0.01, seed: int = 20260624, background: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(Q, U, I) of shape (channel, y, x); Q's noise is drawn before U's. ``background``: correlated noise, means of 5 neighbours."""
    rng = np.random.default_rng(seed)
    shape = (len(freq_mhz), ny, nx)
    q, u = (rng.normal(0, noise, shape) for _ in range(2))
    i = rng.normal(0, noise / 2, shape) if any(s.i0 for s in sources) else np.zeros(shape)
    if background:
        for c in (q, u):
            b = rng.normal(0, background, shape)
            c += (b + sum(np.roll(b, d, a) for a in (1, 2) for d in (1, -1))) / 5
    lsq = lambda_squared(freq_mhz)
    yy, xx = np.mgrid[:ny, :nx]
    for s in sources:
        if s.fwhm:
            blob = np.exp(-4 * np.log(2) * ((xx - s.x) ** 2 + (yy - s.y) ** 2) / s.fwhm**2)
        else:
            blob = ((xx == s.x) & (yy == s.y)).astype(float)
        slope = (np.asarray(freq_mhz) / freq_mhz[0]) ** s.index
        angle = 2 * (s.chi0 + s.rm * lsq)
        q += (s.p0 * slope * np.cos(angle))[:, None, None] * blob
        u += (s.p0 * slope * np.sin(angle))[:, None, None] * blob
        i += (s.i0 * slope)[:, None, None] * blob
    return q, u, i


def two_sources(noise: float = 0.01) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frequencies in MHz, Q, U): 32 x 32 pixels, 200 channels, sources at (12, 10) and (22, 20)."""
    # fixed values: frequencies, places, depths, intensities and angles of the test cube (FIXTURES.md, F1)
    freq = 550.0 + np.arange(200)
    q, u, _ = cube(32, 32, freq, [Source(12, 10, -5.0, 1.0), Source(22, 20, 22.0, 0.8, np.radians(30))], noise)
    return freq, q, u


def with_bad_channels(q: np.ndarray, u: np.ndarray, channel: int = 50, pixels=((12, 10), (12, 11), (13, 10)), empty=((25, 25),)) -> tuple[np.ndarray, np.ndarray]:
    """Copies with NaN in one channel of some pixels and in all channels of others; pixels are (x, y) from 0."""
    q, u = q.copy(), u.copy()
    for c in (q, u):
        for x, y in pixels:
            c[channel, y, x] = np.nan
        for x, y in empty:
            c[:, y, x] = np.nan
    return q, u


def cube_header(nx: int, ny: int, freq0_hz: float, step_hz: float) -> dict[str, object]:
    """Cards of a four-axis cube: sky, frequency, Stokes."""
    # fixed values: the cards of the test cube (FIXTURES.md, F1)
    return {
        "CTYPE1": "RA---SIN", "CRVAL1": 180.0, "CRPIX1": float(nx // 2 + 1), "CDELT1": -0.001, "CUNIT1": "deg", "CTYPE2": "DEC--SIN", "CRVAL2": 0.0, "CRPIX2": float(ny // 2 + 1), "CDELT2": 0.001, "CUNIT2": "deg",
        "CTYPE3": "FREQ", "CRVAL3": freq0_hz, "CRPIX3": 1.0, "CDELT3": step_hz, "CUNIT3": "Hz", "CTYPE4": "STOKES", "CRVAL4": 1.0, "CRPIX4": 1.0, "CDELT4": 1.0, "BUNIT": "Jy/beam", "OBJECT": "TEST", "EQUINOX": 2000.0,
    }


def write_cube(path: str, data: np.ndarray, cards: dict[str, object]) -> None:
    """A small float32 cube (channel, y, x) as a four-axis FITS file; for tests, not for large data."""
    from ..sources.fits_format import BLOCK, header_bytes, primary_cards

    body = np.ascontiguousarray(data, ">f4").tobytes()
    with open(path, "wb") as f:
        f.write(header_bytes(primary_cards(-32, [data.shape[2], data.shape[1], data.shape[0], 1], cards)) + body + b"\0" * (-len(body) % BLOCK))


def run_log(tiles: int = 7, runs: int = 2) -> list[str]:
    """Lines of a log: ``runs`` runs of ``tiles`` tiles, the last tile smaller, one end missing, writes over reads."""
    out, t = [], 0

    def stamp(seconds: float) -> str:
        return f"{np.datetime64('2026-07-12T14:00:00.000') + np.timedelta64(round(seconds * 1000), 'ms')}"

    def say(at: float, stage: str, msg: str) -> None:
        out.append((at, f"{stamp(at)} [debug] [{stage}] [tid=0] {msg}"))

    for r in range(runs):
        say(t, "startup", "run started")
        for k in range(tiles):
            y0, y1 = 1 + 5 * k, min(5 * k + 5, 5 * tiles - 3)
            where, size = f"x:[1,32] y:[{y0},{y1}]", 4096 * (y1 - y0 + 1)
            a = t + 1 + 4 * k
            for stage, start, long in (("tile_read", 0, 1.5), ("tile_mask", 1.5, 0.25), ("tile_compute", 1.75, 2), ("tile_write", 3.75, 2.5)):
                say(a + start, stage, f"start {where} bytes={size}")
                if (r, k, stage) != (1, tiles - 1, "tile_write"):
                    say(a + start + long + 0.125 * r, stage, f"done {where}")
        t += 4 * tiles + 1000
    return [line for _, line in sorted(out)]
