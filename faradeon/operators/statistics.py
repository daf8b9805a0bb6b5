"""Statistics of columns and groups: means, robust means, fits, histograms, correlation, covariance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null


def moments(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """mean, rms (about the mean, population), minimum, maximum, largest absolute value, n."""
    v = nan_to_null(column)
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("rms"), F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.max(F.abs(v)).alias("absmax"), F.count(v).alias("n"))


def robust_moments(df: DataFrame, column: str, by: list[str], sigmas: float = 4.0, within: float = 0.05, most: int = 50) -> DataFrame:
    """mean, rms and n of each group after cutting at ``sigmas`` again and again until rms changes by under ``within``.

    Every step is a grouped aggregation joined back, so a group may be larger than a task. Steps end when no
    group changes.
    """
    rows = df.select(*by, nan_to_null(column).alias("_v")).where("_v is not null")
    found = rows.groupBy(*by).agg(F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("rms"), F.count("_v").alias("n")).withColumn("done", F.lit(False))
    kept, before = df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined(), None
    for _ in range(most):
        found = found.checkpoint() if kept else found.persist()
        some = found.where(~F.col("done")).limit(1).count()
        if before is not None and not kept:
            before.unpersist()
        before = found
        if not some:
            break
        left = rows.join(found.where(~F.col("done")), by).where(F.abs(F.col("_v") - F.col("mean")) <= sigmas * F.col("rms"))
        new = left.groupBy(*by).agg(F.avg("_v").alias("m2"), F.stddev_pop("_v").alias("r2"), F.count("_v").alias("n2"))
        found = found.join(new, by, "left").select(
            *by, F.coalesce("m2", "mean").alias("mean"), F.coalesce("r2", "rms").alias("rms"), F.coalesce("n2", "n").alias("n"),
            (F.col("done") | F.col("r2").isNull() | (F.col("rms") == 0) | (F.abs(F.col("r2") / F.nullif("rms", F.lit(0.0)) - 1) < within)).alias("done"),
        )
    return found.select(*by, "mean", "rms", "n")


def robust_meanrms(values: np.ndarray, sigmas: float = 4.0, within: float = 0.05, most: int = 50) -> tuple[float, float, int]:
    """The same for one array."""
    v = np.asarray(values, np.float64)
    v = v[~np.isnan(v)]
    mean, rms, n = (float(v.mean()), float(v.std()), len(v)) if len(v) else (np.nan, np.nan, 0)
    for _ in range(most):
        kept = v[np.abs(v - mean) <= sigmas * rms]
        if not len(kept) or rms == 0:
            break
        new = float(kept.std())
        same = abs(new / rms - 1) < within
        mean, rms, n = float(kept.mean()), new, len(kept)
        if same:
            break
    return mean, rms, n


def linear_fit(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """intercept a and slope b of y = a + b x."""
    return df.groupBy(*by).agg(F.regr_intercept(F.col(y), F.col(x)).alias("a"), F.regr_slope(F.col(y), F.col(x)).alias("b"), F.count("*").alias("n"))


def dot(df: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    """Sum of products, and its mean."""
    p = F.col(a) * F.col(b)
    return df.groupBy(*by).agg(F.sum(p).alias("dot"), F.avg(p).alias("dot_mean"))


def covariance(df: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.covar_samp(a, b).alias("covariance"))


def order_statistic(rows: DataFrame, column: str, k: int, n: int, accuracy: int = 10_000, few: int = 100_000) -> float:
    """The k-th smallest (from 0) of the ``n`` values of a column without nulls.

    Approximate quantiles on both sides of the rank close in on it until few values are left between them; each
    step is an aggregation that combines before the shuffle, so no task holds all distinct values.
    """
    v = F.col(column)
    part, below, size, margin = rows, 0, n, 2 / accuracy
    while size > few:
        p = (k - below) / (size - 1)
        low, high = part.agg(F.percentile_approx(v, [max(p - margin, 0.0), min(p + margin, 1.0)], accuracy).alias("p")).first()["p"]
        inside = (v > low) & (v < high)
        less, lows, between, highs = part.agg(*(F.count_if(c) for c in (v < low, v == low, inside, v == high))).first()
        at = k - below - less
        if 0 <= at < lows:
            return low
        if lows <= at < lows + between:
            part, below, size = part.where(inside), below + less + lows, between
        elif 0 <= at - lows - between < highs:
            return high
        else:
            margin *= 4
    counts = part.groupBy(v.alias("v")).agg(F.count("*").alias("c"))
    return counts.withColumn("upto", F.sum("c").over(Window.orderBy("v"))).where(F.col("upto") > k - below).agg(F.min("v")).first()[0]


def percentile(rows: DataFrame, column: str, fraction: float) -> float | None:
    """Value at ``fraction`` (0 to 1) of the way through the sorted values of a column without nulls, between two of them in proportion."""
    n = rows.count()
    if not n:
        return None
    at = fraction * (n - 1)
    k = int(at)
    low = order_statistic(rows, column, k, n)
    if at == k:
        return low
    upto, above = rows.agg(F.count_if(F.col(column) <= low), F.min(F.when(F.col(column) > low, F.col(column)))).first()
    high = low if upto > k + 1 else above
    return (k + 1 - at) * low + (at - k) * high


def trimmed_histogram(df: DataFrame, column: str, bins: int, percent: float = 0.0) -> DataFrame:
    """bin (from 1), lo, hi, n, and the mean and rms of what is left after ``percent`` of the values go at each end.

    Counts are of [lo, hi); the last bin takes its upper end too. The cut values are exact percentiles,
    in proportion between two values.
    """
    rows = df.select(nan_to_null(column).cast("double").alias("v")).where("v is not null")
    if percent:
        low, high = percentile(rows, "v", percent / 100), percentile(rows, "v", 1 - percent / 100)
        ends = df.sparkSession.range(1).select(F.lit(low).cast("double").alias("lo"), F.lit(high).cast("double").alias("hi"))
    else:
        ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    kept = rows.crossJoin(F.broadcast(ends)).where("v between lo and hi")  # `ends` is one row
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.greatest(F.floor((F.col("v") - F.col("lo")) / F.nullif(width, F.lit(0.0))) + 1, F.lit(1)), F.lit(bins))
    counts = kept.groupBy(F.coalesce(at, F.lit(1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    whole = kept.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("rms"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    grid = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(whole))
    out = grid.join(counts, "bin", "left")
    return out.select("bin", (F.col("lo") + width * (F.col("bin") - 1)).alias("lo"), (F.col("lo") + width * F.col("bin")).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"), "mean", "rms")


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.asarray(a, np.float64) @ np.asarray(b, np.float64)


def inverse(m: np.ndarray) -> np.ndarray:
    """Inverse of a square matrix; a singular one is an error."""
    return np.linalg.inv(np.asarray(m, np.float64))


def matrix_products(df: DataFrame) -> DataFrame:
    """id, product array<array<double>> of rows with matrices a and b (arrays of arrays)."""

    def run(batches):
        for batch in batches:
            out = [multiply(x, y).tolist() for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.list_(pa.float64())))], names=["id", "product"])

    return df.select(F.col("id").cast("long"), "a", "b").mapInArrow(run, "id long, product array<array<double>>")
