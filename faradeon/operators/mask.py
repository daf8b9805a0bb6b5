"""Sub-images, masks and good-sample weights of long cubes (x, y, chan, q, u)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINEL = -999.0


def check_range(name: str, first: int, last: int, step: int, size: int) -> int:
    """Last place of a range (0: the end of the axis); ranges that are empty or leave the axis are an error."""
    last = last or size
    if step < 1 or first < 1 or last < first or last > size:
        raise ValueError(f"{name}: {first}..{last} step {step} isn't within 1..{size}")
    return last


def sub_range(df: DataFrame, column: str, first: int, last: int, step: int = 1) -> DataFrame:
    """Keep every ``step``-th place of [first, last] and count what is left from 1."""
    c = F.col(column)
    kept = df.where(c.between(first, last) & ((c - first) % step == 0))
    return kept.withColumn(column, ((c - first) / step + 1).cast("int"))


def sub_cube(df: DataFrame, x=(1, 0, 1), y=(1, 0, 1), chan=(1, 0, 1), sizes: tuple[int, int, int] | None = None) -> DataFrame:
    """A box with strides; each axis is (first, last, step), last 0 being the end. ``sizes`` validates the box."""
    for k, (name, (first, last, step)) in enumerate((("x", x), ("y", y), ("chan", chan))):
        last = check_range(name, first, last, step, sizes[k]) if sizes else last or (1 << 31) - 1
        df = sub_range(df, name, first, last, step)
    return df


def pinned(df: DataFrame, *axes: str) -> DataFrame:
    """Place 1 of axes that are neither position nor frequency."""
    for a in axes:
        df = df.where(F.col(a) == 1)
    return df.drop(*axes)


def is_nan(*columns: str) -> Column:
    c = F.lit(False)
    for name in columns:
        c = c | F.col(name).isNull() | F.isnan(name)
    return c


def is_infinite(*columns: str) -> Column:
    c = F.lit(False)
    for name in columns:
        c = c | (F.abs(F.col(name)) == float("inf"))
    return c


def is_sentinel(*columns: str) -> Column:
    c = F.lit(False)
    for name in columns:
        c = c | (F.abs(F.col(name) - SENTINEL) < 1e-6)
    return c


def weighted(df: DataFrame, channels: DataFrame | None = None, mask: DataFrame | None = None, nan_check: bool = True, infinite: bool = False) -> DataFrame:
    """Add ``w``: 1 for a good sample, 0 for a bad one; q and u of bad samples become 0.

    Bad is: a channel with flag 0 in ``channels`` (chan, flag; as many rows as the axis), NaN or null (unless
    ``nan_check`` is off), infinite (on request), -999, and 0.5 or less in ``mask`` (x, y, chan, m). A sample that
    ``mask`` lacks is bad.
    """
    bad = is_sentinel("q", "u")
    if nan_check:
        bad = bad | is_nan("q", "u")
    if infinite:
        bad = bad | is_infinite("q", "u")
    if channels is not None:
        # at most as many rows as the frequency axis has channels
        df = df.join(F.broadcast(channels.select("chan", "flag")), "chan", "left")
        bad = bad | (F.coalesce("flag", F.lit(1)) == 0)
    if mask is not None:
        df = df.join(mask.select("x", "y", "chan", "m"), ["x", "y", "chan"], "left")
        bad = bad | ~(F.coalesce("m", F.lit(0.0)) > 0.5)
    w = F.when(F.coalesce(bad, F.lit(True)), 0).otherwise(1)
    out = df.withColumn("w", w).withColumn("q", F.when(F.col("w") == 1, F.col("q")).otherwise(0.0)).withColumn("u", F.when(F.col("w") == 1, F.col("u")).otherwise(0.0))
    return out.drop("flag", "m")


def valid_counts(df: DataFrame) -> DataFrame:
    """x, y, nvalid."""
    return df.groupBy("x", "y").agg(F.sum("w").cast("int").alias("nvalid"))


def compatible(a: dict, b: dict) -> None:
    """Raise unless two cubes have equal axes (names, lengths, reference values, pixels and increments)."""
    for key in ("naxis", "naxes", "freq_axis", "crval", "crpix", "cdelt"):
        if a.get(key) != b.get(key):
            raise ValueError(f"cubes differ in {key}: {a.get(key)} and {b.get(key)}")
