"""Algebra and statistics of 2-D images (x, y, val) and of planes of cubes, as joins, projections and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null, ratio_or_zero, valid


def aligned(*images: DataFrame, how: str = "inner", check: bool = False) -> DataFrame:
    """x, y, v1, v2, ... of images on one grid. ``check``: raise unless all have as many pixels as meet."""
    out = images[0].select("x", "y", F.col("val").alias("v1"))
    for k, image in enumerate(images[1:], 2):
        out = out.join(image.select("x", "y", F.col("val").alias(f"v{k}")), ["x", "y"], how)
    if check:
        sizes = {i.count() for i in images} | {out.count()}
        if len(sizes) > 1:
            raise ValueError(f"images differ in size: {sorted(sizes)}")
    return out


def rules(a: float = 1.0, b: float = 1.0) -> dict[str, Column]:
    """Image algebra of v1 and v2: sum, difference, linear combination, product, quotient."""
    one, two = F.col("v1"), F.col("v2")
    return {"SUM": one + two, "DIFF": one - two, "LIN": a * one + b * two, "MULT": one * two, "DIV": one / F.nullif(two, F.lit(0.0))}


def summaries(pair: DataFrame, a: float = 1.0, b: float = 1.0) -> DataFrame:
    """op, n, mean, rms of all combinations of a pair, from one pass over it."""
    every = rules(a, b)
    valid_ = {op: F.when(~F.isnan(v), v) for op, v in every.items()}
    sums = pair.agg(*(f(v).alias(f"{name}_{op}") for op, v in valid_.items() for name, f in (("n", F.count), ("mean", F.avg), ("rms", F.stddev_pop))))
    rows = F.array(*(F.struct(F.lit(op).alias("op"), *(F.col(f"{name}_{op}").alias(name) for name in ("n", "mean", "rms"))) for op in every))
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def combine(pair: DataFrame, op: str, a: float = 1.0, b: float = 1.0) -> DataFrame:
    """x, y, val: SUM, DIFF, LIN (a v1 + b v2), MULT or DIV of v1 and v2."""
    return pair.select("x", "y", rules(a, b)[op.upper()].alias("val"))


def summary(image: DataFrame) -> DataFrame:
    """n, mean, rms (about the mean, population) of what is no NaN."""
    v = nan_to_null("val")
    return image.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("rms"))


def pair_points(pair: DataFrame, threshold: float) -> DataFrame:
    """x, y, v2, v1 where the second image reaches the threshold."""
    return pair.where(valid("v2") & (F.col("v2") >= threshold)).select("x", "y", "v2", "v1")


def both_above(pair: DataFrame, cut: float) -> DataFrame:
    return pair.where(valid("v1") & valid("v2") & (F.col("v1") > cut) & (F.col("v2") > cut))


def sign_class(image: DataFrame, kind: str, threshold: float = 0.0) -> DataFrame:
    """Pixels of a class: 'all', 'above' or 'below' the threshold."""
    rule = {"all": F.lit(True), "above": F.col("val") > threshold, "below": F.col("val") < threshold}[kind]
    return image.where(valid("val") & rule)


def ratio_image(pair: DataFrame) -> DataFrame:
    return pair.select("x", "y", ratio_or_zero("v1", "v2").alias("val"))


def half_shifted(image: DataFrame, nx: int, ny: int) -> DataFrame:
    """Quadrants exchanged, so that pixel (0, 0) goes to the centre: x and y (from 0) move by half of their sizes."""
    moved = [F.pmod(F.col(c) + n // 2, F.lit(n)).cast("int").alias(c) for c, n in (("x", nx), ("y", ny))]
    return image.select(*moved, *(c for c in image.columns if c not in ("x", "y")))


def brightest(images: DataFrame) -> DataFrame:
    """image, x, y, val of the brightest pixel of each image (ties: least y, then x)."""
    best = F.max(F.when(valid("val"), F.struct("val", (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))))
    return images.groupBy("image").agg(best.alias("b")).select("image", (-F.col("b.x")).alias("x"), (-F.col("b.y")).alias("y"), F.col("b.val").alias("val"))


def gather(pixels: DataFrame, *images: DataFrame) -> DataFrame:
    """Values of several images at chosen positions (x, y)."""
    out = pixels.select("x", "y").distinct()
    for k, image in enumerate(images, 1):
        out = out.join(image.select("x", "y", F.col("val").alias(f"v{k}")), ["x", "y"], "left")
    return out


def plane(cube: DataFrame, index: str, *places: int) -> DataFrame:
    return cube.where(F.col(index).isin(*places))


def line_cut(cube: DataFrame, axis: str, place: int) -> DataFrame:
    return cube.where(F.col(axis) == place)


def cut_out(image: DataFrame, x0: int, y0: int, nx: int, ny: int, even: bool = False) -> DataFrame:
    """A box of nx by ny around a centre, counted from 1; ``even`` makes odd sizes even."""
    nx, ny = (n + n % 2 if even else n for n in (nx, ny))
    bx, by = x0 - nx // 2, y0 - ny // 2
    inside = F.col("x").between(bx, bx + nx - 1) & F.col("y").between(by, by + ny - 1)
    return image.where(inside).withColumn("x", F.col("x") - bx + 1).withColumn("y", F.col("y") - by + 1)


def blank(image: DataFrame) -> DataFrame:
    return image.withColumn("val", F.lit(float("nan")))


def long_form(cube: DataFrame) -> DataFrame:
    """x, y, chan, q, u, lp of good samples."""
    return cube.where(F.col("w") == 1).select("x", "y", "chan", "q", "u", F.sqrt(F.col("q") * F.col("q") + F.col("u") * F.col("u")).alias("lp"))


def exploded_spectra(spectra: DataFrame) -> DataFrame:
    """Long rows from arrays q, u, w by channel."""
    rows = spectra.select("x", "y", F.posexplode(F.arrays_zip("q", "u", "w")).alias("chan", "s"))
    return long_form(rows.select("x", "y", "chan", "s.q", "s.u", "s.w"))


def plane_means(cube: DataFrame, column: str = "val", index: str = "chan") -> DataFrame:
    """Mean of each plane over its valid pixels."""
    v = nan_to_null(column)
    return cube.groupBy(index).agg(F.avg(v).alias("mean"), F.count(v).alias("n"))


def pixel_statistics(cube: DataFrame, column: str = "val", index: str = "chan", slope: bool = False) -> DataFrame:
    """x, y, maxloc (first), maxval, mean, rms (population), totflux (mean n), thresh (mean / rms, null if rms is 0).

    ``slope``: statistics of what is left of a straight line over ``index``.
    """
    v = nan_to_null(column)
    if slope:
        fit = cube.where(valid(column)).groupBy("x", "y").agg(F.regr_slope(F.col(column), F.col(index)).alias("_b"), F.regr_intercept(F.col(column), F.col(index)).alias("_a"))
        cube = cube.join(fit, ["x", "y"]).withColumn(column, F.col(column) - F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)) * F.col(index))
    at = F.max_by(F.col(index), F.when(v.isNotNull(), F.struct(F.col(column), -F.col(index))))
    out = cube.groupBy("x", "y").agg(at.alias("maxloc"), F.max(v).alias("maxval"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("rms"), F.count(v).alias("n"))
    return out.select("x", "y", "maxloc", "maxval", "mean", "rms", (F.col("mean") * F.col("n")).alias("totflux"), (F.col("mean") / F.nullif("rms", F.lit(0.0))).alias("thresh"))


def stacked_profile(cube: DataFrame, column: str = "val", index: str = "chan", threshold: float = 20.0) -> DataFrame:
    """Mean profile over the pixels whose mean is over ``threshold`` rms."""
    strong = pixel_statistics(cube, column, index).where(F.col("thresh") > threshold).select("x", "y")
    return cube.join(strong, ["x", "y"], "left_semi").groupBy(index).agg(F.avg(nan_to_null(column)).alias("profile"), F.count(nan_to_null(column)).alias("n"))


def weighted_fraction(rows: DataFrame, part: str = "q", whole: str = "i") -> DataFrame:
    """sum(part whole) / sum(whole whole)."""
    return rows.agg((F.sum(F.col(part) * F.col(whole)) / F.nullif(F.sum(F.col(whole) * F.col(whole)), F.lit(0.0))).alias("fraction"))


def radial_profile(image: DataFrame, nx: int, ny: int) -> DataFrame:
    """ring, mean, rms, n about the centre: place n / 2 + 1 of an even axis, (n + 1) / 2 of an odd one, counted from 1."""
    cx, cy = (n // 2 + 1 for n in (nx, ny))
    dx, dy = F.col("x") - cx, F.col("y") - cy
    ring = (1 + F.floor(F.sqrt((dx * dx + dy * dy).cast("double")))).cast("int")
    v = nan_to_null("val")
    return image.groupBy(ring.alias("ring")).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("rms"), F.count(v).alias("n"))
