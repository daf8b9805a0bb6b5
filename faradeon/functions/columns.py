"""Column functions: order statistics, polarisation, coordinates, cyclic shifts, log fields."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .axes import C_MHZ

Col = Column | str


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def valid(x: Col) -> Column:
    """Neither null nor NaN."""
    return _c(x).isNotNull() & ~F.isnan(_c(x).cast("double"))


def nan_to_null(x: Col) -> Column:
    return F.when(valid(x), _c(x))


def null_to_nan(x: Col) -> Column:
    return F.coalesce(_c(x).cast("double"), F.lit(float("nan")))


def lower_median(values: Col) -> Column:
    """Element (n + 1) / 2 of the sorted array, counted from 1; nothing is interpolated."""
    s = F.array_sort(_c(values))
    return F.try_element_at(s, F.floor((F.size(s) + 1) / 2).cast("int"))


def upper_median(values: Col) -> Column:
    s = F.array_sort(_c(values))
    return F.try_element_at(s, F.floor(F.size(s) / 2).cast("int") + 1)


def lower_quantile(values: Col, q: float) -> Column:
    """Element floor(q (n - 1)) + 1 of the sorted array, counted from 1."""
    s = F.array_sort(_c(values))
    return F.try_element_at(s, F.floor(F.lit(q) * (F.size(s) - 1)).cast("int") + 1)


def linspace_array(beg: Col, end: Col, n: Col) -> Column:
    beg, end = _c(beg), _c(end)
    n = F.when(_c(n) < 1, 100).otherwise(_c(n))
    steps = F.transform(F.sequence(F.lit(0), n - 1), lambda k: beg + (end - beg) / F.nullif(n - 1, F.lit(0)) * k)
    return F.when(n == 1, F.array(end.cast("double"))).otherwise(steps)


def amplitude(re: Col, im: Col) -> Column:
    return F.sqrt(_c(re) * _c(re) + _c(im) * _c(im))


def phase(re: Col, im: Col) -> Column:
    return F.atan2(_c(im), _c(re))


def pol_angle(re: Col, im: Col) -> Column:
    return phase(re, im) / 2


def linear_polarisation(q: Col, u: Col) -> Column:
    return amplitude(q, u)


def qu_from_angle(lp: Col, angle: Col, doubled: bool = False) -> tuple[Column, Column]:
    """Q and U of polarised intensity and phase angle (radians), or of the polarisation angle, half of it (``doubled``); 0 where either is missing."""
    ok = valid(lp) & valid(angle)
    return tuple(F.when(ok, _c(lp) * f((2 if doubled else 1) * _c(angle))).otherwise(0.0) for f in (F.cos, F.sin))


def leakage_corrected(stokes: Col, intensity: Col, leakage: Col) -> Column:
    return _c(stokes) - _c(leakage) * _c(intensity)


def bias_corrected(stokes: Col, intensity: Col, slope: float, residual: float) -> Column:
    """Less ``slope * I + residual``; the slope's sign follows whether the value is below the residual, row by row."""
    sign = F.when(_c(stokes) >= residual, 1.0).otherwise(-1.0)
    return _c(stokes) - (_c(intensity) * sign * slope + residual)


def ratio_or_zero(x: Col, y: Col) -> Column:
    """y / x; 0 where x is 0."""
    return F.when(_c(x) == 0, 0.0).otherwise(_c(y) / _c(x))


def fractional_polarisation(lp: Col, i: Col) -> Column:
    """LP / I; 1.2 where that is missing or LP exceeds the absolute I."""
    f = _c(lp) / F.nullif(_c(i), F.lit(0.0))
    return F.when(valid(f) & (_c(lp) <= F.abs(_c(i))), f).otherwise(1.2)


def not_negative(x: Col) -> Column:
    return F.when(_c(x) < 0, 0.0).otherwise(_c(x))


def correlation_or_zero(a: Col, b: Col) -> Column:
    """Correlation over a group; 0 where a side doesn't vary."""
    return F.coalesce(nan_to_null(F.corr(_c(a), _c(b))), F.lit(0.0))


def complex_correlation(ar: Col, ai: Col, br: Col, bi: Col) -> tuple[Column, Column]:
    """Real and imaginary part of sum(a conj b) / sqrt(sum |a|^2 sum |b|^2); 0 where a side is 0."""
    ar, ai, br, bi = map(_c, (ar, ai, br, bi))
    norm = F.sqrt(F.sum(ar * ar + ai * ai) * F.sum(br * br + bi * bi))
    part = lambda x: F.when(norm == 0, 0.0).otherwise(F.sum(x) / norm)
    return part(ar * br + ai * bi), part(ai * br - ar * bi)


def cyclic_shift(values: Col, by: int) -> Column:
    """Elements moved ``by`` places to the right, those past the end to the front."""
    v = _c(values)
    n = F.size(v)
    k = F.pmod(F.lit(by), F.greatest(n, F.lit(1))).cast("int")
    return F.when(n == 0, v).otherwise(F.concat(F.slice(v, n - k + 1, k), F.slice(v, F.lit(1), n - k)))


# -- axes as arrays of a row's own numbers


def channel_frequencies(crval: Col, crpix: Col, cdelt: Col, n: Col) -> Column:
    """Frequencies in MHz of a row's ``n`` channels: a CRVAL in [30, 1e4] is in MHz, in [30e6, 10e9] in Hz, others give null.

    The unit is told once a row: within ``transform`` it would be told again for each channel.
    """
    first = _c(crval) - (F.greatest(F.lit(1), _c(crpix).cast("int")) - 1) * _c(cdelt)
    axis = lambda unit: F.transform(F.sequence(F.lit(0), _c(n) - 1), lambda k: (first + _c(cdelt) * k) * unit)
    return F.when(_c(crval).between(30, 1e4), axis(1.0)).when(_c(crval).between(30e6, 10e9), axis(1e-6))


def lambda_squared(mhz: Col) -> Column:
    return F.pow(C_MHZ / _c(mhz), F.lit(2.0))


def rm_axis(beg: Col, end: Col, n: Col) -> Column:
    """A row's ``n`` depths. A range over 0 gets an exact 0 and one step that fits both sides, so it may end before a far end."""
    b, e, m = _c(beg), _c(end), _c(n)
    below = F.least(F.greatest(F.floor((m - 1) * (-b / (e - b)) + 0.5), F.lit(1)), m - 2)
    even = F.least(-b / below, e / (m - 1 - below))
    k = F.sequence(F.lit(0), F.greatest(m, F.lit(1)) - 1)
    return F.when(m <= 1, F.array(b)).when((m >= 3) & (b < 0) & (e > 0), F.transform(k, lambda j: (j - below) * even)).otherwise(F.transform(k, lambda j: b + (e - b) / (m - 1) * j))


def auto_rm_half(mhz: Col, fac: float = math.pi) -> Column:
    """Half of the range of depths that fits the frequencies of an array (two or more), with one depth a channel."""
    f = F.array_sort(_c(mhz))
    n = F.size(f)
    lo, hi = F.element_at(f, 1), F.element_at(f, -1)
    step = (hi - lo) / (n - 1)
    return 0.5 * (n - 1) * fac / (lambda_squared(lo - step / 2) - lambda_squared(hi + step / 2))


def rm_resolution(freq_hz: Col, bandwidth_hz: Col, c: float = 3e8) -> Column:
    """Resolution in rad/m^2 of one of a row's channels."""
    return math.pi * F.pow(_c(freq_hz), F.lit(3.0)) / (2 * c**2 * _c(bandwidth_hz))


def _digits(seed: int, keys: tuple[Col, ...]) -> Column:
    """32 hexadecimal digits that belong to a seed and a row's keys; a null key is its own value."""
    text = [F.coalesce(F.concat(F.lit("k"), _c(k).cast("string")), F.lit("n")) for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(int(seed))), *text).cast("binary"))


def _fraction(digits: Column, first: int) -> Column:
    """13 of the digits as a number from 0 to 1, without 1."""
    return F.conv(F.substring(digits, first, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def uniform(seed: int, *keys: Col) -> Column:
    """A number from [0, 1) that follows from the seed and the row's keys alone, whatever partition the row is in."""
    return _fraction(_digits(seed, keys), 1)


def normal(seed: int, *keys: Col) -> Column:
    """A standard normal number (Box and Muller's form) that follows from the seed and the row's keys alone."""
    d = _digits(seed, keys)
    return F.sqrt(-2 * F.ln(1 - _fraction(d, 1))) * F.cos(2 * math.pi * _fraction(d, 14))


def noisy(value: Col, sigma: float, seed: int, *keys: Col) -> Column:
    """Value plus normal noise that belongs to the row's keys."""
    if not keys:
        raise ValueError("noise belongs to rows by their keys: name the columns that tell rows apart")
    return _c(value) + sigma * normal(seed, *keys)


def trimmed_length(text: Col) -> Column:
    """Place of the last character that is no space, tab or NUL."""
    return F.length(F.regexp_replace(_c(text), "[ \t\\x00]+$", ""))


def flag(text: Col) -> Column:
    return F.lower(F.substring(_c(text), 1, 1)).isin("1", "y", "t")


def iso_timestamp(ts: Col) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS")


# -- coordinates; angles in radians unless said otherwise


def hour_angle_to_parallactic(ha: Col, dec: Col, latitude: Col) -> Column:
    ha, dec, lat = map(_c, (ha, dec, latitude))
    return F.atan2(F.sin(ha) * F.cos(lat), F.sin(lat) * F.cos(dec) - F.cos(lat) * F.sin(dec) * F.cos(ha))


def azimuth_zenith(ha: Col, dec: Col, latitude: Col) -> tuple[Column, Column]:
    """(azimuth from north through east in [0, 2 pi), zenith distance)."""
    ha, dec, lat = map(_c, (ha, dec, latitude))
    east, north = -F.cos(dec) * F.sin(ha), F.sin(dec) * F.cos(lat) - F.cos(dec) * F.cos(ha) * F.sin(lat)
    up = F.sin(dec) * F.sin(lat) + F.cos(dec) * F.cos(ha) * F.cos(lat)
    turn = F.lit(2 * math.pi)
    return F.pmod(F.atan2(east, north), turn), F.acos(F.greatest(F.least(up, F.lit(1.0)), F.lit(-1.0)))


def equatorial(azimuth: Col, zenith: Col, latitude: Col, lst: Col) -> tuple[Column, Column]:
    """(right ascension in [0, 2 pi), declination) of a direction at local sidereal time ``lst``."""
    az, za, lat, lst = map(_c, (azimuth, zenith, latitude, lst))
    dec = F.asin(F.greatest(F.least(F.cos(za) * F.sin(lat) + F.sin(za) * F.cos(lat) * F.cos(az), F.lit(1.0)), F.lit(-1.0)))
    ha = F.atan2(-F.sin(za) * F.sin(az), F.cos(za) * F.cos(lat) - F.sin(za) * F.sin(lat) * F.cos(az))
    return F.pmod(lst - ha, F.lit(2 * math.pi)), dec


def sidereal_time(azimuth: Col, zenith: Col, latitude: Col, ra: Col) -> Column:
    """Local sidereal time at which a source of right ascension ``ra`` is seen in a direction."""
    az, za, lat = map(_c, (azimuth, zenith, latitude))
    ha = F.atan2(-F.sin(za) * F.sin(az), F.cos(za) * F.cos(lat) - F.sin(za) * F.sin(lat) * F.cos(az))
    return F.pmod(_c(ra) + ha, F.lit(2 * math.pi))


def greenwich_sidereal_degrees(julian_day: Col) -> Column:
    """Mean sidereal time at Greenwich, IAU 1982, in degrees."""
    d = _c(julian_day) - 2451545.0
    t = d / 36525.0
    return F.pmod(280.46061837 + 360.98564736629 * d + 0.000387933 * t * t - t * t * t / 38710000.0, F.lit(360.0))


#: Precession angles in seconds of arc: constant and slope (by centuries from the system's epoch) of the linear terms,
#: then the quadratic and cubic terms of zeta, z, theta. IAU 1976 for FK5, Newcomb for FK4; fixed values.
PRECESSION = {
    "FK5": {"epoch": 2000.0, "first": (2306.2181, 1.39656, -0.000139), "zeta": (0.30188, -0.000344, 0.017998), "z": (1.09468, 0.000066, 0.018203), "theta": (2004.3109, -0.85330, -0.000217, -0.42665, -0.000217, -0.041833)},
    "FK4": {"epoch": 1900.0, "first": (2304.250, 1.396, 0.0), "zeta": (0.302, 0.0, 0.018), "z": (1.093, 0.0, 0.018), "theta": (2004.682, -0.853, 0.0, -0.426, 0.0, -0.042)},
}


def precession_angles(from_year: float, to_year: float, system: str = "FK5") -> tuple[float, float, float]:
    """Angles zeta, z, theta in radians between two epochs: Julian ones of FK5 (J2000), Besselian ones of FK4 (B1950)."""
    k = PRECESSION[system]
    big, t = (from_year - k["epoch"]) / 100, (to_year - from_year) / 100
    arc = math.pi / 180 / 3600
    a, b, c = k["first"]
    first = (a + b * big + c * big * big) * t
    zeta, z = (first + (k[n][0] + k[n][1] * big) * t**2 + k[n][2] * t**3 for n in ("zeta", "z"))
    a, b, c, d, e, f = k["theta"]
    theta = (a + b * big + c * big * big) * t + (d + e * big) * t**2 + f * t**3
    return zeta * arc, z * arc, theta * arc


def precessed(ra: Col, dec: Col, from_year: float, to_year: float, system: str = "FK5") -> tuple[Column, Column]:
    ra, dec = _c(ra), _c(dec)
    zeta, z, theta = precession_angles(from_year, to_year, system)
    a = F.cos(dec) * F.sin(ra + zeta)
    b = math.cos(theta) * F.cos(dec) * F.cos(ra + zeta) - math.sin(theta) * F.sin(dec)
    c = math.sin(theta) * F.cos(dec) * F.cos(ra + zeta) + math.cos(theta) * F.sin(dec)
    return F.pmod(F.atan2(a, b) + z, F.lit(2 * math.pi)), F.asin(F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0)))
