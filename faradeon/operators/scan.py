"""Running sums along an order that is longer than a task: within parts, and carried from part to part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, by: list[str], part: Column, order: list, sums: dict[str, str]) -> DataFrame:
    """``rows`` with running sums (new name: column) in ``order`` within groups.

    ``part`` cuts a group into parts that rise with the order. A part's rows are summed in one task, and what came before
    it is added from a table of one row a group and part. Both are dealt by the same key, a struct, in which nulls are
    equal; so rows move once.
    """
    at = rows.withColumn("_part", part).withColumn("_key", F.struct(*by, "_part"))
    groups = [F.col("_key").getField(c) for c in by]
    before = Window.partitionBy(*groups).orderBy(F.col("_key._part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = at.groupBy("_key").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items())).select("_key", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums))
    own = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = at.select("*", *(F.sum(c).over(own).alias(f"_o_{n}") for n, c in sums.items())).join(totals, "_key")
    return whole.select(*(c for c in rows.columns if c not in sums), *((F.col(f"_b_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums))


def bias_corrected(df: DataFrame, values: dict[str, tuple[float, float]], intensity: str = "i", order: list[str] = ("y", "x"), channel: str = "chan", part: Column | None = None) -> DataFrame:
    """Each of ``values`` (column: slope, residual) less ``slope * I + residual``, where the slope's sign turns at every
    value under the residual and stays turned, from sample to sample and from pixel to pixel.

    This is the form of the published program: samples follow one another by ``order`` (pixels), and within a pixel
    from the last channel to the first. Turns compose by counting, so a part of the sky is counted in one task, and the
    parities of the parts before are carried over. ``part`` (the first of ``order`` by default) must rise with the order. Missing values turn the sign too.
    """
    turns = {f"_turn_{c}": F.when(F.col(c).isNull() | F.isnan(c) | (F.col(c) < r), 1).otherwise(0) for c, (_, r) in values.items()}
    counted = running(df.withColumns(turns), [], F.col(order[0]) if part is None else part, [*order, F.desc(channel)], {f"_n_{c}": f"_turn_{c}" for c in values})
    sign = lambda c: F.when(F.col(f"_n_{c}") % 2 == 0, 1.0).otherwise(-1.0)
    fixed = {c: F.col(c) - (F.col(intensity) * sign(c) * slope + residual) for c, (slope, residual) in values.items()}
    return counted.withColumns(fixed).select(*df.columns)
