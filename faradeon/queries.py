"""Queries over the driver's tables, one for each operator, and the SQL that gives the same rows.

There are no FITS cubes among the tables, so a cube is derived from ``events`` (25 pixels, 64 channels) and images
from ``lineitem``. Names start with the operator's number in the survey.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import columns as C
from .functions.axes import Axes, rm_axis
from .operators import cubestat, images, mask, runlog, statistics, synthesis

N_CHAN, BAD = 64, (11, 31)
FREQ = 700.0 + 4.0 * np.arange(N_CHAN)
RM = rm_axis(-40.0, 40.0, 41)
AXES = Axes.of(FREQ, RM, [b + 1 for b in BAD])

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# -- the derived tables in SQL
_CUBE = """raw AS (SELECT CAST((event_id % 25) % 5 AS INT) AS x, CAST((event_id % 25) // 5 AS INT) AS y, CAST((event_id // 25) % 64 AS INT) AS chan,
  avg(value * cos(user_id * 0.1)) AS q0, avg(value * sin(user_id * 0.1)) AS u0, count(*) AS n, sum(value) AS i FROM events GROUP BY 1, 2, 3),
cube AS (SELECT x, y, chan, n, i, CASE WHEN w = 1 THEN q0 ELSE 0 END AS q, CASE WHEN w = 1 THEN u0 ELSE 0 END AS u, w FROM
  (SELECT *, CASE WHEN chan IN (11, 31) OR i < 40 THEN 0 ELSE 1 END AS w FROM raw))"""
_AXES = """chans AS (SELECT CAST(range AS INT) AS chan, CAST(700 + 4 * range AS DOUBLE) AS freq, pow(299.792458 / (700.0 + 4.0 * range), 2) AS lsq FROM range(64)),
depths AS (SELECT CAST(range AS INT) AS irm, CAST((range - 20) * 2 AS DOUBLE) AS rm FROM range(41))"""
_FAR = """far AS (SELECT x, y, irm, rm, sum(w * (q * cos(2 * rm * lsq) + u * sin(2 * rm * lsq))) / nullif(sum(w), 0) AS re,
  sum(w * (u * cos(2 * rm * lsq) - q * sin(2 * rm * lsq))) / nullif(sum(w), 0) AS im, sum(w) AS w
  FROM cube JOIN chans USING (chan) CROSS JOIN depths GROUP BY 1, 2, 3, 4),
lng AS (SELECT *, round(sqrt(re * re + im * im), 9) AS amp, atan2(im, re) AS ang FROM far)"""
_IMG = """img AS (SELECT CAST(l_suppkey % 32 AS INT) AS x, CAST(l_partkey % 32 AS INT) AS y, sum(l_quantity) AS val FROM lineitem GROUP BY 1, 2),
im2 AS (SELECT CAST(l_suppkey % 32 AS INT) AS x, CAST(l_partkey % 32 AS INT) AS y, sum(l_quantity * l_discount) AS val FROM lineitem GROUP BY 1, 2),
pair AS (SELECT x, y, img.val AS v1, im2.val AS v2 FROM img JOIN im2 USING (x, y))"""
_PLANES = """planes AS (SELECT CAST(l_suppkey % 8 AS INT) AS x, CAST(l_partkey % 8 AS INT) AS y, CAST(month(l_shipdate) AS INT) AS chan, sum(l_quantity) AS val FROM lineitem GROUP BY 1, 2, 3)"""
_LOG = """ev AS (SELECT event_id, ts, CAST(user_id % 4 AS INT) AS tid, event_type AS stage, CASE WHEN (event_id // 8) % 2 = 0 THEN 'start' ELSE 'done' END AS event, CAST(abs(value) * 1000 AS BIGINT) AS bytes FROM events),
spans AS (SELECT s.tid, s.stage, s.k, s.ts AS t0, d.ts AS t1, (epoch_us(d.ts) - epoch_us(s.ts)) / 1e6 AS seconds, coalesce(s.bytes, d.bytes) AS bytes FROM
  (SELECT *, row_number() OVER (PARTITION BY tid, stage, event ORDER BY ts, event_id) AS k FROM ev WHERE event = 'start') s JOIN
  (SELECT *, row_number() OVER (PARTITION BY tid, stage, event ORDER BY ts, event_id) AS k FROM ev WHERE event = 'done') d USING (tid, stage, k) WHERE d.ts > s.ts)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cube(spark: SparkSession, d: str) -> DataFrame:
    """x, y, chan, q, u, w, n, i: channels 11 and 31 and samples of weak intensity are bad."""
    e = read(spark, d, "events").select("event_id", "user_id", "value")
    p, angle = F.col("event_id") % 25, F.col("user_id") * 0.1
    raw = e.groupBy((p % 5).cast("int").alias("x"), F.floor(p / 5).cast("int").alias("y"), (F.floor(F.col("event_id") / 25) % 64).cast("int").alias("chan")).agg(
        F.avg(F.col("value") * F.cos(angle)).alias("q"), F.avg(F.col("value") * F.sin(angle)).alias("u"), F.count("*").alias("n"), F.sum("value").alias("i")
    )
    flagged = raw.withColumn("q", F.when(F.col("i") < 40, F.lit(mask.SENTINEL)).otherwise(F.col("q")))
    return mask.weighted(flagged, AXES.channels(spark))


def far(spark: SparkSession, d: str) -> DataFrame:
    return synthesis.relational(cube(spark, d), AXES.channels(spark), AXES.depths(spark))


def long(spark: SparkSession, d: str) -> DataFrame:
    return far(spark, d).withColumn("amp", F.round(C.amplitude("re", "im"), 9)).withColumn("ang", C.phase("re", "im"))


def image(spark: SparkSession, d: str, column: str = "l_quantity") -> DataFrame:
    v = F.col("l_quantity") * (F.col("l_discount") if column == "l_discount" else F.lit(1.0))
    return read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 32).cast("int").alias("x"), (F.col("l_partkey") % 32).cast("int").alias("y")).agg(F.sum(v).alias("val"))


def pair(spark: SparkSession, d: str) -> DataFrame:
    return images.aligned(image(spark, d), image(spark, d, "l_discount"))


def planes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 8).cast("int").alias("x"), (F.col("l_partkey") % 8).cast("int").alias("y"), F.month("l_shipdate").alias("chan")).agg(F.sum("l_quantity").alias("val"))


def log_events(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select("event_id", "ts", (F.col("user_id") % 4).cast("int").alias("tid"), F.col("event_type").alias("stage"), F.when(F.floor(F.col("event_id") / 8) % 2 == 0, "start").otherwise("done").alias("event"), (F.abs("value") * 1000).cast("decimal(20,0)").cast("long").alias("bytes"))


def spans(spark: SparkSession, d: str) -> DataFrame:
    return runlog.intervals(log_events(spark, d), ["tid", "stage"], ties=["event_id"])


def rounded(df: DataFrame, *names: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), n) + 0.0 for c in names})


# -- filters and projections


@query("f1_sub_image", _with(_CUBE) + "SELECT CAST((x - 1) / 2 + 1 AS INT) AS x, y, CAST((chan - 5) // 3 + 1 AS INT) AS chan, round(q, 6) + 0.0 AS q FROM cube WHERE x BETWEEN 1 AND 4 AND (x - 1) % 2 = 0 AND chan BETWEEN 5 AND 50 AND (chan - 5) % 3 = 0")
def f1(s, d):
    c = mask.sub_range(mask.sub_range(cube(s, d), "x", 1, 4, 2), "chan", 5, 50, 3)
    return rounded(c.select("x", "y", "chan", "q"), "q")


@query("f3_pinned_axes", _with(_PLANES) + "SELECT x, y, round(val, 6) AS val FROM planes WHERE chan = 1")
def f3(s, d):
    return rounded(mask.pinned(planes(s, d), "chan"), "val")


@query("f8_unified_mask", _with(_CUBE) + "SELECT x, y, chan, w, round(q, 6) + 0.0 AS q, round(u, 6) + 0.0 AS u FROM cube")
def f8(s, d):
    return rounded(cube(s, d).select("x", "y", "chan", "w", "q", "u"), "q", "u")


@query("f7_input_mask", _with(_CUBE) + "SELECT x, y, CAST(sum(CASE WHEN w = 1 AND (x + y + chan) % 3 > 0 THEN 1 ELSE 0 END) AS INT) AS nvalid FROM cube GROUP BY 1, 2")
def f7(s, d):
    c = cube(s, d)
    m = c.select("x", "y", "chan", F.when((F.col("x") + F.col("y") + F.col("chan")) % 3 > 0, 1.0).otherwise(0.5).alias("m"))
    good = c.withColumn("q", F.when(F.col("w") == 0, F.lit(float("nan"))).otherwise(F.col("q"))).drop("w")
    return mask.valid_counts(mask.weighted(good, mask=m))


@query("f9_threshold_points", _with(_IMG) + "SELECT x, y, round(v2, 6) AS v2, round(v1, 6) AS v1 FROM pair WHERE v2 >= 20")
def f9(s, d):
    return rounded(images.pair_points(pair(s, d), 20.0), "v1", "v2")


@query("f10_dual_cut", _with(_IMG) + "SELECT x, y, round(v1, 6) AS v1, round(v2, 6) AS v2 FROM pair WHERE v1 > 10 AND v2 > 10")
def f10(s, d):
    return rounded(images.both_above(pair(s, d), 10.0), "v1", "v2")


@query("f11_sign_class", _with(_CUBE) + "SELECT x, y, chan, round(q, 6) AS q FROM cube WHERE q < -5")
def f11(s, d):
    return rounded(images.sign_class(cube(s, d).withColumnRenamed("q", "val"), "below", -5.0).select("x", "y", "chan", F.col("val").alias("q")), "q")


@query("f12_plane_slice", _with(_CUBE, _AXES, _FAR) + "SELECT x, y, irm, round(re, 6) + 0.0 AS re FROM far WHERE irm IN (3, 20)")
def f12(s, d):
    return rounded(images.plane(far(s, d), "irm", 3, 20).select("x", "y", "irm", "re"), "re")


@query("f13_line_cut", _with(_CUBE) + "SELECT x, y, chan, round(q, 6) + 0.0 AS q, round(u, 6) + 0.0 AS u FROM cube WHERE y = 2")
def f13(s, d):
    return rounded(images.line_cut(cube(s, d), "y", 2).select("x", "y", "chan", "q", "u"), "q", "u")


@query("f14_long_form", _with(_CUBE) + "SELECT x, y, chan, round(sqrt(q * q + u * u), 6) AS lp FROM cube WHERE w = 1")
def f14(s, d):
    spec = synthesis.spectra(cube(s, d), N_CHAN)
    return rounded(images.exploded_spectra(spec).select("x", "y", "chan", "lp"), "lp")


@query("f15_blank_image", _with(_IMG) + "SELECT x, y, CAST('nan' AS DOUBLE) AS val FROM img")
def f15(s, d):
    return images.blank(image(s, d))


@query("s9_cut_out", _with(_IMG) + "SELECT CAST(x - 11 AS INT) AS x, CAST(y - 6 AS INT) AS y, round(val, 6) AS val FROM img WHERE x BETWEEN 12 AND 19 AND y BETWEEN 7 AND 12")
def s9(s, d):
    return rounded(images.cut_out(image(s, d), 16, 10, 8, 6), "val")


# -- axes and the transform


#: An observation for each part: frequencies of 6 to 13 channels from 700 MHz up, some in Hz, and a range of depths.
_OBS = """obs AS (SELECT p_partkey, 6 + p_partkey % 8 AS n, CAST(700 + p_size AS DOUBLE) AS mhz, CAST(1 + p_partkey % 5 AS DOUBLE) AS width, CAST(-10 - p_size AS DOUBLE) AS beg, CAST(p_partkey % 70 - 5 AS DOUBLE) AS til FROM part),
chan AS (SELECT p_partkey, n, width, k, mhz + (k - 1) * width AS f FROM (SELECT *, unnest(range(n)) AS k FROM obs))"""


def _observations(s, d) -> DataFrame:
    k = F.col("p_partkey")
    unit = F.when(k % 3 == 0, 1e6).otherwise(1.0)
    rows = read(s, d, "part").select("p_partkey", (6 + k % 8).cast("int").alias("n"), ((700.0 + F.col("p_size")) * unit).alias("crval"), ((1.0 + k % 5) * unit).alias("cdelt"), (-10.0 - F.col("p_size")).alias("beg"), (k % 70 - 5.0).alias("til"))
    return rows.withColumn("mhz", C.channel_frequencies("crval", F.lit(2.7), "cdelt", F.col("n")))


@query("p3_channel_axis", _with(_OBS) + "SELECT p_partkey, CAST(k AS INT) AS chan, round(f, 6) AS freq, round(pow(299.792458 / f, 2), 9) AS lsq FROM chan")
def p3(s, d):
    """Channels of every row's own axis; the reference pixel is truncated to an integer."""
    rows = _observations(s, d).select("p_partkey", F.posexplode("mhz").alias("chan", "freq"))
    return rounded(rounded(rows.withColumn("lsq", C.lambda_squared("freq")), "freq"), "lsq", n=9)


@query("p6_rm_axis", _with(_OBS) + """, cut AS (SELECT *, least(greatest(floor((n - 1) * (-beg / (til - beg)) + 0.5), 1), n - 2) AS below FROM obs)
SELECT p_partkey, CAST(k AS INT) AS irm, round(CASE WHEN til > 0 THEN (k - below) * least(-beg / below, til / (n - 1 - below)) ELSE beg + (til - beg) / (n - 1) * k END, 6) + 0.0 AS rm FROM (SELECT *, unnest(range(n)) AS k FROM cut)""")
def p6(s, d):
    return rounded(_observations(s, d).select("p_partkey", F.posexplode(C.rm_axis("beg", "til", "n")).alias("irm", "rm")), "rm")


@query("p4_mean_removed", _with(_CUBE) + "SELECT x, y, chan, round(w * (q - m), 6) + 0.0 AS q FROM cube JOIN (SELECT x, y, coalesce(sum(w * q) / nullif(sum(w), 0), 0) AS m FROM cube GROUP BY 1, 2) USING (x, y)")
def p4(s, d):
    return rounded(synthesis.mean_removed(cube(s, d)).select("x", "y", "chan", "q"), "q")


@query("p5_bias_corrected", _with(_CUBE) + "SELECT x, y, chan, round(q - (i * CASE WHEN q >= 0.5 THEN 0.01 ELSE -0.01 END + 0.5), 6) + 0.0 AS q FROM cube WHERE w = 1")
def p5(s, d):
    c = cube(s, d).where("w = 1")
    return rounded(c.select("x", "y", "chan", C.bias_corrected("q", "i", 0.01, 0.5).alias("q")), "q")


_SPECTRUM = _with(_CUBE, _AXES, _FAR) + "SELECT x, y, irm, rm, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM far"


@query("p10_rm_spectrum", _SPECTRUM)
def p10(s, d):
    return rounded(far(s, d).select("x", "y", "irm", "rm", "re", "im"), "re", "im")


@query("p10_rm_spectrum_arrow", _SPECTRUM)
def p10_arrow(s, d):
    arrays = synthesis.synthesise(synthesis.spectra(cube(s, d), N_CHAN), AXES, "ri", precision="double").drop("nvalid")
    rows = synthesis.exploded(arrays, AXES.depths(s)).select("x", "y", "irm", "rm", "re", "im")
    return rounded(rows.withColumns({c: C.nan_to_null(c) for c in ("re", "im")}), "re", "im")


@query("p11_unweighted", _with(_CUBE, _AXES) + "SELECT x, y, irm, round(sum(q * cos(2 * rm * lsq) + u * sin(2 * rm * lsq)) / count(*), 6) + 0.0 AS re FROM cube JOIN chans USING (chan) CROSS JOIN depths WHERE w = 1 GROUP BY 1, 2, 3")
def p11(s, d):
    c = cube(s, d).where("w = 1").withColumn("w", F.lit(1))
    return rounded(synthesis.relational(c, AXES.channels(s), AXES.depths(s)).select("x", "y", "irm", "re"), "re")


@query("p12_amplitude_angle", _with(_CUBE, _AXES, _FAR) + "SELECT x, y, irm, round(amp, 6) AS amp, round(cos(ang), 6) + 0.0 AS c, round(sin(ang / 2) * sin(ang / 2), 6) + 0.0 AS s FROM lng")
def p12(s, d):
    rows = far(s, d).select("x", "y", "irm", C.amplitude("re", "im").alias("amp"), F.cos(C.phase("re", "im")).alias("c"), F.pow(F.sin(C.pol_angle("re", "im")), 2).alias("s"))
    return rounded(rows, "amp", "c", "s")


@query("p13_nvalid", _with(_CUBE) + "SELECT x, y, CAST(sum(w) AS INT) AS nvalid FROM cube GROUP BY 1, 2")
def p13(s, d):
    return mask.valid_counts(cube(s, d))


_MEANS = """m AS (SELECT x, y, sum(w * q) / nullif(sum(w), 0) AS mq, sum(w * u) / nullif(sum(w), 0) AS mu FROM cube GROUP BY 1, 2)"""


@query("p10_mean_removed", _with(_CUBE, _AXES, _MEANS) + "SELECT x, y, irm, round(sum(w * ((q - mq) * cos(2 * rm * lsq) + (u - mu) * sin(2 * rm * lsq))) / nullif(sum(w), 0), 6) + 0.0 AS re FROM cube JOIN m USING (x, y) JOIN chans USING (chan) CROSS JOIN depths GROUP BY 1, 2, 3")
def p10_mean(s, d):
    arrays = synthesis.synthesise(synthesis.spectra(cube(s, d), N_CHAN), AXES, "ri", remove_mean=True, precision="double")
    rows = synthesis.exploded(arrays.select("x", "y", "re"), AXES.depths(s)).select("x", "y", "irm", C.nan_to_null("re").alias("re"))
    return rounded(rows, "re")


@query("stream_partial_sums", _SPECTRUM)
def stream_sums(s, d):
    from .streaming import finished, partial_sums

    return rounded(finished(partial_sums(cube(s, d), AXES.channels(s), AXES.depths(s))).select("x", "y", "irm", "rm", "re", "im"), "re", "im")


@query("p7_auto_rm_axis", _with(_OBS) + """, ends AS (SELECT p_partkey, n, min(f) AS lo, max(f) AS hi, (max(f) - min(f)) / (n - 1) AS step FROM chan GROUP BY 1, 2)
SELECT p_partkey, round(-0.5 * (n - 1) * pi() / (pow(299.792458 / (lo - step / 2), 2) - pow(299.792458 / (hi + step / 2), 2)), 6) AS first FROM ends""")
def p7(s, d):
    return rounded(_observations(s, d).select("p_partkey", (-C.auto_rm_half("mhz")).alias("first")), "first")


@query("p15_rm_resolution", _with(_OBS) + "SELECT p_partkey, CAST(k AS INT) AS chan, round(pi() * pow(f * 1e6, 3) / (2 * pow(3e8, 2) * width * 1e6), 6) AS step, round(n * pi() * pow(f * 1e6, 3) / (2 * pow(3e8, 2) * width * 1e6), 6) AS span FROM chan")
def p15(s, d):
    width = (1.0 + F.col("p_partkey") % 5) * 1e6
    rows = _observations(s, d).select("p_partkey", "n", F.posexplode("mhz").alias("chan", "f")).withColumn("step", C.rm_resolution(F.col("f") * 1e6, width))
    return rounded(rows.select("p_partkey", "chan", "step", (F.col("n") * F.col("step")).alias("span")), "step", "span")


def _beam(s, d, parts: str) -> DataFrame:
    """Each pixel's response, with its own weights, to a unit source at depth 10 with angle 0.3."""
    angle = 2 * (0.3 + 10 * F.col("lsq"))
    c = cube(s, d).join(F.broadcast(AXES.channels(s).select("chan", "lsq")), "chan")
    q, u = (f(angle) if k in parts else F.lit(0.0) for k, f in (("Q", F.cos), ("U", F.sin)))
    unit = c.select("x", "y", "chan", q.alias("q"), u.alias("u"), "w")
    return rounded(synthesis.relational(unit, AXES.channels(s), AXES.depths(s)).select("x", "y", "irm", "re", "im"), "re", "im")


_UNIT = "SELECT x, y, irm, round(sum(w * ({q} * cos(2 * rm * lsq) + {u} * sin(2 * rm * lsq))) / nullif(sum(w), 0), 6) + 0.0 AS re, round(sum(w * ({u} * cos(2 * rm * lsq) - {q} * sin(2 * rm * lsq))) / nullif(sum(w), 0), 6) + 0.0 AS im FROM cube JOIN chans USING (chan) CROSS JOIN depths GROUP BY 1, 2, 3"


@query("p16_dirty_beam", _with(_CUBE, _AXES) + _UNIT.format(q="cos(2 * (0.3 + 10 * lsq))", u="sin(2 * (0.3 + 10 * lsq))"))
def p16(s, d):
    return _beam(s, d, "QU")


@query("p17_dirty_beam_q", _with(_CUBE, _AXES) + _UNIT.format(q="cos(2 * (0.3 + 10 * lsq))", u="0"))
def p17(s, d):
    return _beam(s, d, "Q")


@query("p24_component_phase", _with(_CUBE, _AXES) + "SELECT x, y, round(cos(p), 6) + 0.0 AS c, round(sin(p), 6) + 0.0 AS s FROM (SELECT x, y, atan2(vs * cc - vc * cs, vc * ss - vs * cs) AS p FROM (SELECT x, y, sum(w * q * cos(12 * lsq)) AS vc, sum(w * q * sin(12 * lsq)) AS vs, sum(w * cos(12 * lsq) * cos(12 * lsq)) AS cc, sum(w * sin(12 * lsq) * sin(12 * lsq)) AS ss, sum(w * cos(12 * lsq) * sin(12 * lsq)) AS cs FROM cube JOIN chans USING (chan) GROUP BY 1, 2))")
def p24(s, d):
    from .operators.clean import component_phases

    c = cube(s, d).join(F.broadcast(AXES.channels(s).select("chan", "lsq")), "chan")
    return rounded(component_phases(c, "q", 6.0).select("x", "y", F.cos("phase").alias("c"), F.sin("phase").alias("s")), "c", "s")


@query("p25_profile_noise", _with(_CUBE, _AXES, _FAR, "beam AS (SELECT irm, sqrt(pow(avg(cos(2 * rm * lsq)), 2) + pow(avg(sin(2 * rm * lsq)), 2)) AS beam FROM chans CROSS JOIN depths WHERE chan NOT IN (11, 31) GROUP BY 1)", "tops AS (SELECT x, y, max(amp) AS peak FROM lng GROUP BY 1, 2)") + "SELECT x, y, round(stddev_pop(amp - peak * beam), 6) AS rms FROM lng JOIN tops USING (x, y) JOIN beam USING (irm) WHERE irm < 30 GROUP BY 1, 2")
def p25(s, d):
    from .operators.clean import dirty_beam, profile_noises

    beam = s.createDataFrame([(k, float(v)) for k, v in enumerate(np.abs(dirty_beam(AXES)))], "irm int, beam double")
    return rounded(profile_noises(long(s, d), beam, first=30), "rms")


# -- joins


@query("j1_q_with_u", _with(_CUBE) + "SELECT x, y, chan, round(a.q0, 6) + 0.0 AS q, round(b.u0, 6) + 0.0 AS u FROM raw a JOIN raw b USING (x, y, chan)")
def j1(s, d):
    e = read(s, d, "events")
    p, angle = F.col("event_id") % 25, F.col("user_id") * 0.1
    keys = [(p % 5).cast("int").alias("x"), F.floor(p / 5).cast("int").alias("y"), (F.floor(F.col("event_id") / 25) % 64).cast("int").alias("chan")]
    q, u = (e.groupBy(*keys).agg(F.avg(F.col("value") * f(angle)).alias(n)) for f, n in ((F.cos, "q"), (F.sin, "u")))
    return rounded(q.join(u, ["x", "y", "chan"]), "q", "u")


@query("j3_channel_axis_join", _with(_CUBE, _AXES) + "SELECT x, y, chan, round(lsq, 9) AS lsq FROM cube JOIN chans USING (chan)")
def j3(s, d):
    return rounded(cube(s, d).join(F.broadcast(AXES.channels(s).select("chan", "lsq")), "chan").select("x", "y", "chan", "lsq"), "lsq", n=9)


@query("j5_images_on_grid", _with(_IMG) + "SELECT x, y, round(v1, 6) AS v1, round(v2, 6) AS v2 FROM pair")
def j5(s, d):
    return rounded(pair(s, d), "v1", "v2")


@query("j6_gather_pixels", _with(_IMG) + "SELECT p.x, p.y, round(a.val, 6) AS v1, round(b.val, 6) AS v2 FROM (SELECT x, y FROM img WHERE val > 40) p LEFT JOIN img a USING (x, y) LEFT JOIN im2 b USING (x, y)")
def j6(s, d):
    return rounded(images.gather(image(s, d).where("val > 40"), image(s, d), image(s, d, "l_discount")), "v1", "v2")


# -- aggregates


@query("a3_moments", _with(_CUBE) + "SELECT chan, round(avg(q), 6) + 0.0 AS mean, round(stddev_pop(q), 6) AS rms, round(min(q), 6) + 0.0 AS minimum, round(max(q), 6) + 0.0 AS maximum, round(max(abs(q)), 6) AS absmax, count(q) AS n FROM cube GROUP BY 1")
def a3(s, d):
    return rounded(statistics.moments(cube(s, d), "q", ["chan"]), "mean", "rms", "minimum", "maximum", "absmax")


@query("a5_first_argmax", _with(_PLANES) + "SELECT x, y, CAST(min(chan) AS INT) AS chan FROM planes JOIN (SELECT x, y, max(val) AS val FROM planes GROUP BY 1, 2) USING (x, y, val) GROUP BY 1, 2")
def a5(s, d):
    return planes(s, d).groupBy("x", "y").agg(cubestat.first_argmax("chan", "val", "chan").alias("chan"))


@query("a5b_last_argmax", _with(_PLANES) + "SELECT x, y, CAST(max(chan) AS INT) AS chan FROM planes JOIN (SELECT x, y, max(val) AS val FROM planes GROUP BY 1, 2) USING (x, y, val) GROUP BY 1, 2")
def a5b(s, d):
    return planes(s, d).groupBy("x", "y").agg(cubestat.last_argmax("chan", "val", "chan").alias("chan"))


_TAIL = """s AS (SELECT x, y, max(amp) AS peak, arg_min(rm, irm) AS rm_peak, list_sort(list(amp)) AS a FROM (SELECT *, max(amp) OVER (PARTITION BY x, y) AS top FROM lng) WHERE amp = top GROUP BY 1, 2),
t AS (SELECT x, y, list_sort(list(amp)) AS a FROM lng WHERE amp IS NOT NULL GROUP BY 1, 2),
g AS (SELECT x, y, peak, rm_peak, t.a AS a, t.a[(len(t.a) + 1) // 2] AS q50, t.a[CAST(floor(0.16 * (len(t.a) - 1)) AS INT) + 1] AS q16 FROM s JOIN t USING (x, y)),
h AS (SELECT *, list_sort([abs(v - q50) FOR v IN a])[(len(a) + 1) // 2] AS mad FROM g)"""


_PEAK_SNR = _with(_CUBE, _AXES, _FAR, _TAIL) + "SELECT x, y, round(peak, 6) AS peak, rm_peak, round(peak / greatest(CASE WHEN q50 - q16 > 0 THEN (q50 - q16) / 0.67449 ELSE 1.4826 * mad END, 1e-12), 6) AS snr FROM h"


@query("a6_peak_snr", _PEAK_SNR)
def a6(s, d):
    """The flagship: spectra once, one matrix product a batch, peaks and noise of arrays."""
    arrays = synthesis.synthesise(synthesis.spectra(cube(s, d), N_CHAN), AXES, precision="double")
    return rounded(cubestat.peak_maps(arrays, RM).where("peak is not null").select("x", "y", "peak", "rm_peak", "snr"), "peak", "snr")


@query("a6_peak_snr_relational", _PEAK_SNR)
def a6_relational(s, d):
    return rounded(cubestat.peaks(long(s, d)).where("peak is not null").select("x", "y", "peak", "rm_peak", "snr"), "peak", "snr")


@query("p14_peak_maps_arrow", _with(_CUBE, _AXES, _FAR, _TAIL) + "SELECT x, y, round(peak, 5) AS peak, rm_peak, round(peak / greatest(CASE WHEN q50 - q16 > 0 THEN (q50 - q16) / 0.67449 ELSE 1.4826 * mad END, 1e-12), 4) AS snr FROM h")
def p14(s, d):
    arrays = synthesis.synthesise(synthesis.spectra(cube(s, d), N_CHAN), AXES, precision="double")
    maps = cubestat.peak_maps(arrays, RM).where("peak is not null").select("x", "y", "peak", "rm_peak", "snr")
    return rounded(rounded(maps, "peak", n=5), "snr", n=4)


@query("a7_upper_median", _with(_PLANES) + "SELECT x, y, round(a[len(a) // 2 + 1], 6) AS upper, round(a[(len(a) + 1) // 2], 6) AS lower FROM (SELECT x, y, list_sort(list(val)) AS a FROM planes GROUP BY 1, 2)")
def a7(s, d):
    rows = planes(s, d).groupBy("x", "y").agg(F.collect_list("val").alias("a"))
    return rounded(rows.select("x", "y", C.upper_median("a").alias("upper"), C.lower_median("a").alias("lower")), "upper", "lower")


@query("a8_robust_mean_rms", """WITH RECURSIVE v AS (SELECT user_id % 8 AS g, value FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
cuts AS (SELECT g, avg(value) AS mean, stddev_pop(value) AS rms, count(*) AS n, false AS done, 0 AS step FROM v GROUP BY g
UNION ALL SELECT c.g, avg(value), stddev_pop(value), count(*), c.rms = 0 OR abs(stddev_pop(value) / nullif(c.rms, 0) - 1) < 0.05, c.step + 1 FROM cuts c JOIN v ON v.g = c.g AND abs(value - c.mean) <= 4 * c.rms WHERE NOT c.done AND c.step < 50 GROUP BY c.g, c.mean, c.rms, c.step)
SELECT g, round(arg_max(mean, step), 6) + 0.0 AS mean, round(arg_max(rms, step), 6) + 0.0 AS rms, arg_max(n, step) AS n FROM cuts GROUP BY g""")
def a8(s, d):
    return rounded(statistics.robust_moments(read(s, d, "events").select((F.col("user_id") % 8).alias("g"), "value"), "value", ["g"]), "mean", "rms")


@query("a10_correlation", _with(_CUBE) + "SELECT x, y, round(coalesce(CASE WHEN stddev_pop(q) * stddev_pop(i) > 0 THEN corr(q, i) END, 0), 6) + 0.0 AS r, round(CASE WHEN sum(q * q + u * u) = 0 THEN 0 ELSE sum(q * i) / sqrt(sum(q * q + u * u) * sum(i * i)) END, 6) + 0.0 AS re FROM cube GROUP BY 1, 2")
def a10(s, d):
    c = cube(s, d).withColumn("z", F.lit(0.0))
    re, _ = C.complex_correlation("q", "u", "i", "z")
    return rounded(c.groupBy("x", "y").agg(C.correlation_or_zero("q", "i").alias("r"), re.alias("re")), "r", "re")


@query("a11_covariance", _with(_CUBE) + "SELECT chan, round(covar_samp(q, u), 6) + 0.0 AS covariance FROM cube GROUP BY 1")
def a11(s, d):
    return rounded(statistics.covariance(cube(s, d), "q", "u", ["chan"]), "covariance")


@query("a12_dot_products", _with(_CUBE) + "SELECT chan, round(sum(q * u), 6) + 0.0 AS dot, round(avg(q * u), 6) + 0.0 AS dot_mean FROM cube GROUP BY 1")
def a12(s, d):
    return rounded(statistics.dot(cube(s, d), "q", "u", ["chan"]), "dot", "dot_mean")


@query("a13_linear_fit", _with(_CUBE) + "SELECT x, y, round(regr_intercept(i, chan), 6) + 0.0 AS a, round(regr_slope(i, chan), 6) + 0.0 AS b, count(*) AS n FROM cube GROUP BY 1, 2")
def a13(s, d):
    return rounded(statistics.linear_fit(cube(s, d), "chan", "i", ["x", "y"]), "a", "b")


@query(
    "a14_trimmed_histogram",
    """WITH v AS (SELECT l_quantity AS v FROM lineitem), e AS (SELECT quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM v),
k AS (SELECT v, lo, hi, least(greatest(floor((v - lo) / ((hi - lo) / 8)) + 1, 1), 8) AS bin FROM v CROSS JOIN e WHERE v BETWEEN lo AND hi)
SELECT CAST(b.range AS INT) AS bin, lo + (hi - lo) / 8 * (b.range - 1) AS lo, lo + (hi - lo) / 8 * b.range AS hi, coalesce(n, 0) AS n, round(mean, 6) AS mean, round(rms, 6) AS rms
FROM range(1, 9) b LEFT JOIN (SELECT bin, count(*) AS n FROM k GROUP BY 1) c ON b.range = c.bin CROSS JOIN (SELECT min(lo) AS lo, min(hi) AS hi, avg(v) AS mean, stddev_pop(v) AS rms FROM k)""",
)
def a14(s, d):
    return rounded(statistics.trimmed_histogram(read(s, d, "lineitem"), "l_quantity", 8, 10.0), "mean", "rms")


@query("a15_plane_means", _with(_PLANES) + "SELECT chan, round(avg(val), 6) AS mean, count(val) AS n FROM planes GROUP BY 1")
def a15(s, d):
    return rounded(images.plane_means(planes(s, d)), "mean")


_A16 = "SELECT x, y, CAST(min(chan) FILTER (WHERE val = top) AS INT) AS maxloc, round(max(val), 6) AS maxval, round(avg(val), 6) AS mean, round(stddev_pop(val), 6) AS rms, round(avg(val) * count(*), 6) AS totflux, round(avg(val) / nullif(stddev_pop(val), 0), 6) AS thresh FROM (SELECT *, max(val) OVER (PARTITION BY x, y) AS top FROM planes) GROUP BY 1, 2"


@query("a16_pixel_statistics", _with(_PLANES) + _A16)
def a16(s, d):
    return rounded(images.pixel_statistics(planes(s, d)), "maxval", "mean", "rms", "totflux", "thresh")


@query("a16_slope_removed", _with(_PLANES) + "SELECT x, y, round(stddev_pop(val - a - b * chan), 5) + 0.0 AS rms FROM planes JOIN (SELECT x, y, regr_intercept(val, chan) AS a, regr_slope(val, chan) AS b FROM planes GROUP BY 1, 2) USING (x, y) GROUP BY 1, 2")
def a16_slope(s, d):
    return rounded(images.pixel_statistics(planes(s, d), slope=True).select("x", "y", "rms"), "rms", n=5)


@query("a16_stacked_profile", _with(_PLANES, "s AS (SELECT x, y FROM planes GROUP BY 1, 2 HAVING avg(val) / nullif(stddev_pop(val), 0) > 2)") + "SELECT chan, round(avg(val), 6) AS profile, count(*) AS n FROM planes JOIN s USING (x, y) GROUP BY 1")
def a16_stack(s, d):
    return rounded(images.stacked_profile(planes(s, d), threshold=2.0), "profile")


@query("a17_polarised_fraction", _with(_CUBE) + "SELECT round(sum(q * i) / sum(i * i), 9) + 0.0 AS fraction FROM cube")
def a17(s, d):
    return rounded(images.weighted_fraction(cube(s, d)), "fraction", n=9)


@query("a18_radial_profile", _with(_IMG) + "SELECT CAST(1 + floor(sqrt(CAST((x + 1 - 17) * (x + 1 - 17) + (y + 1 - 17) * (y + 1 - 17) AS DOUBLE))) AS INT) AS ring, round(avg(val), 6) AS mean, round(stddev_pop(val), 6) AS rms, count(*) AS n FROM img GROUP BY 1")
def a18(s, d):
    i = image(s, d).withColumn("x", F.col("x") + 1).withColumn("y", F.col("y") + 1)
    return rounded(images.radial_profile(i, 32, 32), "mean", "rms")


# -- windows, sorts


@query("w6_cyclic_shift", "SELECT vec_id, round(CAST(a[1] AS DOUBLE), 6) + 0.0 AS first, round(CAST(a[64] AS DOUBLE), 6) + 0.0 AS last FROM (SELECT vec_id, list_concat(list_slice(embedding, 60, 64), list_slice(embedding, 1, 59)) AS a FROM embeddings)")
def w6(s, d):
    rows = read(s, d, "embeddings").select("vec_id", C.cyclic_shift("embedding", 5).alias("a"))
    return rounded(rows.select("vec_id", F.element_at("a", 1).cast("double").alias("first"), F.element_at("a", -1).cast("double").alias("last")), "first", "last")


@query("o2_sorted_arrays", _with(_PLANES) + "SELECT x, y, list_sort(list(val)) AS up, list_reverse_sort(list(val)) AS down FROM planes GROUP BY 1, 2")
def o2(s, d):
    rows = planes(s, d).groupBy("x", "y").agg(F.collect_list("val").alias("a"))
    return rows.select("x", "y", F.array_sort("a").alias("up"), F.sort_array("a", asc=False).alias("down"))


@query("o4_brightest_pixel", _with(_PLANES) + "SELECT image, x, y, val FROM (SELECT chan AS image, x, y, val, row_number() OVER (PARTITION BY chan ORDER BY val DESC, y, x) AS r FROM planes) WHERE r = 1")
def o4(s, d):
    return images.brightest(planes(s, d).withColumnRenamed("chan", "image"))


# -- scalar functions


@query("x1_strings", "SELECT p_partkey, CAST(length(regexp_replace(p_name || '  ', '[ \t]+$', '')) AS INT) AS n, lower(p_name) AS low, upper(p_name) AS up, lower(substr(p_name, 1, 1)) IN ('1', 'y', 't') AS flag FROM part")
def x1(s, d):
    return read(s, d, "part").select("p_partkey", C.trimmed_length(F.concat("p_name", F.lit("  "))).alias("n"), F.lower("p_name").alias("low"), F.upper("p_name").alias("up"), C.flag("p_name").alias("flag"))


@query("x5_linspace", "SELECT p_partkey, round(CASE WHEN n = 1 THEN p_size ELSE list_sum([1 + (p_size - 1) / nullif(CASE WHEN n < 1 THEN 100 ELSE n END - 1.0, 0) * k FOR k IN range(CASE WHEN n < 1 THEN 100 ELSE n END)]) END, 6) AS total FROM (SELECT *, CAST(p_size % 7 AS INT) AS n FROM part)")
def x5(s, d):
    rows = read(s, d, "part").withColumn("n", (F.col("p_size") % 7).cast("int"))
    return rounded(rows.select("p_partkey", F.aggregate(C.linspace_array(F.lit(1.0), "p_size", "n"), F.lit(0.0), lambda a, x: a + x).alias("total")), "total")


@query("x7_angle_to_qu", "SELECT l_orderkey, l_linenumber, round(l_quantity * cos(10 * l_discount), 6) + 0.0 AS q, round(l_quantity * sin(10 * l_discount), 6) + 0.0 AS u, round(l_quantity * cos(20 * l_tax), 6) + 0.0 AS q2 FROM lineitem")
def x7(s, d):
    q, u = C.qu_from_angle("l_quantity", 10 * F.col("l_discount"))
    q2, _ = C.qu_from_angle("l_quantity", 10 * F.col("l_tax"), doubled=True)
    return rounded(read(s, d, "lineitem").select("l_orderkey", "l_linenumber", q.alias("q"), u.alias("u"), q2.alias("q2")), "q", "u", "q2")


@query("x8_image_algebra", _with(_IMG, "r AS (SELECT 'SUM' AS op, v1 + v2 AS v FROM pair UNION ALL SELECT 'DIFF', v1 - v2 FROM pair UNION ALL SELECT 'LIN', 2 * v1 - 3 * v2 FROM pair UNION ALL SELECT 'MULT', v1 * v2 FROM pair UNION ALL SELECT 'DIV', v1 / nullif(v2, 0) FROM pair)") + "SELECT op, count(v) AS n, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS rms FROM r GROUP BY 1")
def x8(s, d):
    return rounded(images.summaries(pair(s, d), 2.0, -3.0), "mean", "rms", n=5)


@query("x9_leakage", _with(_CUBE) + "SELECT x, y, chan, round(q - 0.02 * i, 6) + 0.0 AS q FROM cube")
def x9(s, d):
    return rounded(cube(s, d).select("x", "y", "chan", C.leakage_corrected("q", "i", F.lit(0.02)).alias("q")), "q")


@query("x10_ratio", _with(_IMG) + "SELECT x, y, round(CASE WHEN v1 = 0 THEN 0 ELSE v2 / v1 END, 6) AS val FROM pair")
def x10(s, d):
    return rounded(images.ratio_image(pair(s, d)), "val")


@query("x11_fractional_polarisation", _with(_CUBE) + "SELECT x, y, chan, round(CASE WHEN i <> 0 AND sqrt(q * q + u * u) <= abs(1.5 * i) THEN sqrt(q * q + u * u) / (1.5 * i) ELSE 1.2 END, 6) + 0.0 AS f, round(CASE WHEN q < 0 THEN 0 ELSE q END, 6) + 0.0 AS p FROM cube")
def x11(s, d):
    return rounded(cube(s, d).select("x", "y", "chan", C.fractional_polarisation(C.linear_polarisation("q", "u"), F.col("i") * 1.5).alias("f"), C.not_negative("q").alias("p")), "f", "p")


@query("x19_coordinates", """SELECT o_orderkey, round(atan2(sin(ha) * cos(0.3), sin(0.3) * cos(de) - cos(0.3) * sin(de) * cos(ha)), 6) + 0.0 AS parallactic,
round(acos(sin(de) * sin(0.3) + cos(de) * cos(ha) * cos(0.3)), 6) AS zenith FROM (SELECT o_orderkey, (o_orderkey % 97) / 97.0 * 3 - 1.5 AS ha, (o_custkey % 89) / 89.0 * 2 - 1 AS de FROM orders)""")
def x19(s, d):
    o = read(s, d, "orders").select("o_orderkey", ((F.col("o_orderkey") % 97) / 97.0 * 3 - 1.5).alias("ha"), ((F.col("o_custkey") % 89) / 89.0 * 2 - 1).alias("de"))
    lat = F.lit(0.3)
    return rounded(o.select("o_orderkey", C.hour_angle_to_parallactic("ha", "de", lat).alias("parallactic"), C.azimuth_zenith("ha", "de", lat)[1].alias("zenith")), "parallactic", "zenith")


@query("x21_iso_timestamp", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS t FROM events")
def x21(s, d):
    return read(s, d, "events").select("event_id", C.iso_timestamp("ts").alias("t"))


# -- run logs


@query("j7_paired_intervals", _with(_LOG) + "SELECT tid, stage, CAST(k AS INT) AS k, round(seconds, 6) AS seconds, bytes FROM spans")
def j7(s, d):
    return spans(s, d).select("tid", "stage", F.col("k").cast("int").alias("k"), "seconds", "bytes")


_SWEEP = """p AS (SELECT tid, stage, epoch_us(t0) AS t, 1 AS d FROM spans UNION ALL SELECT tid, stage, epoch_us(t1), -1 FROM spans)"""


@query("w5_active_counts", _with(_LOG, _SWEEP) + "SELECT tid, t, CAST(max(active) AS BIGINT) AS most FROM (SELECT tid, t, sum(d) OVER (PARTITION BY tid ORDER BY t, d DESC ROWS UNBOUNDED PRECEDING) AS active FROM p) GROUP BY 1, 2")
def w5(s, d):
    return runlog.active_counts(spans(s, d), ["tid"]).groupBy("tid", "t").agg(F.max("active").alias("most"))


@query("j8_self_overlap", _with(_LOG, _SWEEP) + "SELECT tid, round(coalesce(sum(CASE WHEN active >= 2 THEN (n - t) / 1e6 END), 0), 3) AS seconds FROM (SELECT tid, t, sum(d) OVER (PARTITION BY tid ORDER BY t, d DESC ROWS UNBOUNDED PRECEDING) AS active, lead(t) OVER (PARTITION BY tid ORDER BY t, d DESC) AS n FROM p) GROUP BY 1")
def j8_self(s, d):
    return rounded(runlog.self_overlap(spans(s, d), ["tid"]), "seconds", n=3)


@query(
    "j8_cross_overlap",
    _with(_LOG, _SWEEP)
    + """SELECT tid, round(coalesce(sum(CASE WHEN a > 0 AND b > 0 THEN (n - t) / 1e6 END), 0), 3) AS seconds FROM (SELECT tid, t,
sum(CASE WHEN stage = 'click' THEN d ELSE 0 END) OVER w AS a, sum(CASE WHEN stage = 'view' THEN d ELSE 0 END) OVER w AS b, lead(t) OVER (PARTITION BY tid ORDER BY t, d DESC, stage) AS n
FROM p WHERE stage IN ('click', 'view') WINDOW w AS (PARTITION BY tid ORDER BY t, d DESC, stage ROWS UNBOUNDED PRECEDING)) GROUP BY 1""",
)
def j8_cross(s, d):
    return rounded(runlog.cross_overlap(spans(s, d), "stage", "click", "view", ["tid"]), "seconds", n=3)


_RUNS = """r AS (SELECT *, sum(CASE WHEN gap > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY ts RANGE UNBOUNDED PRECEDING) AS run FROM
  (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY tid ORDER BY ts))) / 1e6 AS gap FROM ev))"""


@query("w3_run_split", _with(_LOG, _RUNS) + "SELECT tid, CAST(run AS INT) AS run, count(*) AS n FROM r GROUP BY 1, 2")
def w3(s, d):
    return runlog.split_runs(log_events(s, d), by=["tid"]).groupBy("tid", "run").agg(F.count("*").alias("n"))


@query("w4_run_selection", _with(_LOG, _RUNS) + "SELECT event_id FROM r WHERE tid = 0 AND run = (SELECT max(run) - 1 FROM r WHERE tid = 0)")
def w4(s, d):
    one = runlog.split_runs(log_events(s, d).where("tid = 0"), by=["tid"])
    return runlog.select_run(one, -2).select("event_id")


@query("a19_stage_totals", _with(_LOG) + "SELECT stage, round(sum(seconds), 3) AS seconds, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS n, round(sum(bytes) / 1e6 / greatest(sum(seconds), 1e-6), 9) AS mb_per_s FROM spans GROUP BY 1 ORDER BY 2 DESC")
def a19(s, d):
    return rounded(rounded(runlog.stage_totals(spans(s, d), ["stage"]), "seconds", n=3), "mb_per_s", n=9)


_STAGES = "t AS (SELECT 'total' AS stage, 2.0 * sum(value) AS seconds FROM events UNION ALL SELECT event_type, sum(value) FROM events GROUP BY 1)"


@query("a20_macro_timing", _with(_STAGES) + "SELECT stage, round(seconds, 3) AS seconds, round(100 * seconds / (SELECT max(seconds) FROM t WHERE stage = 'total'), 6) AS percent FROM (SELECT * FROM t UNION ALL SELECT 'other', greatest((SELECT max(seconds) FROM t WHERE stage = 'total') - (SELECT sum(seconds) FROM t WHERE stage <> 'total'), 0))")
def a20(s, d):
    e = read(s, d, "events")
    t = e.agg((2 * F.sum("value")).alias("seconds")).select(F.lit("total").alias("stage"), "seconds").unionByName(e.groupBy(F.col("event_type").alias("stage")).agg(F.sum("value").alias("seconds")))
    return rounded(rounded(runlog.macro_timing(t), "seconds", n=3), "percent")


@query("a21_speed_up", "WITH t AS (SELECT CAST(l_linenumber AS INT) AS threads, sum(l_extendedprice) AS elapsed FROM lineitem GROUP BY 1) SELECT threads, round((SELECT elapsed FROM t WHERE threads = 1) / elapsed, 6) AS speedup FROM t")
def a21(s, d):
    t = read(s, d, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("threads")).agg(F.sum("l_extendedprice").alias("elapsed"))
    return rounded(runlog.speed_up(t).select("threads", "speedup"), "speedup")


# -- fits and kernels without an SQL form


#: Beams of each pixel's weights on the grids of differences and of sums of depths (steps of 2, the first -40).
_BEAMS = """near AS (SELECT x, y, k, sum(w * cos(4 * k * lsq)) / nullif(sum(w), 0) AS b, -sum(w * sin(4 * k * lsq)) / nullif(sum(w), 0) AS c FROM cube JOIN chans USING (chan) CROSS JOIN (SELECT range AS k FROM range(-40, 41)) GROUP BY 1, 2, 3),
mirror AS (SELECT x, y, k, sum(w * cos(2 * (2 * k - 80) * lsq)) / nullif(sum(w), 0) AS b, -sum(w * sin(2 * (2 * k - 80) * lsq)) / nullif(sum(w), 0) AS c FROM cube JOIN chans USING (chan) CROSS JOIN (SELECT range AS k FROM range(81)) GROUP BY 1, 2, 3)"""


def _cleaned_sql(niter: int, stokes: str = "QU") -> str:
    """``niter`` steps of CLEAN: the peak of each residual, and a tenth of the beam there taken off."""
    u = 1 if stokes == "QU" else 0
    steps = [f"""r0 AS (SELECT x, y, irm, sum(w * (q * cos(2 * rm * lsq) + {u} * u * sin(2 * rm * lsq))) / nullif(sum(w), 0) AS re, sum(w * ({u} * u * cos(2 * rm * lsq) - q * sin(2 * rm * lsq))) / nullif(sum(w), 0) AS im
  FROM cube JOIN chans USING (chan) CROSS JOIN depths GROUP BY 1, 2, 3)"""]
    for k in range(niter):
        steps.append(f"p{k} AS (SELECT x, y, arg_max(irm, sqrt(re * re + im * im)) AS place, 0.1 * arg_max(re, re * re + im * im) AS pr, 0.1 * arg_max(im, re * re + im * im) AS pi FROM r{k} GROUP BY 1, 2 HAVING abs(max(sqrt(re * re + im * im)) - avg(sqrt(re * re + im * im))) > 0.5 * stddev_pop(sqrt(re * re + im * im)))")
        own = "n.b * pr - n.c * pi", "n.b * pi + n.c * pr"
        if stokes == "Q":
            own = tuple(f"(({a}) + ({b})) / 2" for a, b in zip(own, ("m.b * pr + m.c * pi", "m.c * pr - m.b * pi"), strict=True))
        steps.append(f"r{k + 1} AS (SELECT r.x, r.y, r.irm, r.re - coalesce({own[0]}, 0) AS re, r.im - coalesce({own[1]}, 0) AS im FROM r{k} r LEFT JOIN p{k} p ON r.x = p.x AND r.y = p.y LEFT JOIN near n ON n.x = p.x AND n.y = p.y AND n.k = r.irm - p.place LEFT JOIN mirror m ON m.x = p.x AND m.y = p.y AND m.k = r.irm + p.place)")
    parts = " UNION ALL ".join(f"SELECT x, y, place AS irm, pr, pi FROM p{k}" for k in range(niter))
    steps.append(f"parts AS (SELECT x, y, irm, sum(pr) AS component_re, sum(pi) AS component_im FROM ({parts}) GROUP BY 1, 2, 3)")
    return _with(_CUBE, _AXES, _BEAMS, *steps) + f"SELECT x, y, irm, round(coalesce(component_re, 0), 6) + 0.0 AS component_re, round(coalesce(component_im, 0), 6) + 0.0 AS component_im, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM r{niter} LEFT JOIN parts USING (x, y, irm)"


def _clean_rows(s, d, niter: int, stokes: str = "QU") -> DataFrame:
    from .operators.clean import clean_components

    arrays = clean_components(synthesis.spectra(cube(s, d), N_CHAN), AXES, threshold=0.5, niter=niter, stokes=stokes).drop("iterations")
    names = ("component_re", "component_im", "re", "im")
    rows = synthesis.exploded(arrays, AXES.depths(s)).select("x", "y", "irm", *names)
    return rounded(rows.withColumns({c: C.nan_to_null(c) for c in names}), *names)


@query("p18_clean_once", _cleaned_sql(1))
def p18_once(s, d):
    return _clean_rows(s, d, 1)


@query("p18_clean_steps", _cleaned_sql(3))
def p18_steps(s, d):
    return _clean_rows(s, d, 3)


@query("p19_clean_q_steps", f"SELECT x, y, irm, re, im FROM ({_cleaned_sql(3, 'Q')})")
def p19_steps(s, d):
    """Residuals alone: a source and its mirror image answer alike, so which of the two depths is taken is a toss-up."""
    return _clean_rows(s, d, 3, "Q").select("x", "y", "irm", "re", "im")


@query("p18_clean")
def p18(s, d):
    from .operators.clean import clean_spectra

    return clean_spectra(synthesis.spectra(cube(s, d), N_CHAN), AXES, niter=200)


_LOGS = """size AS (SELECT x, y, irm, sqrt(re * re + im * im) AS v FROM far),
tops AS (SELECT x, y, arg_max(irm, v) AS place, max(v) AS v FROM size GROUP BY 1, 2),
logs AS (SELECT t.x, t.y, t.place, t.v, log10(l.v) AS a, log10(t.v) AS b, log10(h.v) AS c FROM tops t LEFT JOIN size l ON l.x = t.x AND l.y = t.y AND l.irm = t.place - 1 LEFT JOIN size h ON h.x = t.x AND h.y = t.y AND h.irm = t.place + 1)"""


@query("p22_interpolated_peaks", _with(_CUBE, _AXES, _FAR, _LOGS) + "SELECT x, y, round(-40 + 2 * (place + coalesce(0.5 * (a - c) / (a - 2 * b + c), 0)), 6) AS rm_peak, round(coalesce(pow(10, b - 0.125 * (a - c) * (a - c) / (a - 2 * b + c)), v), 6) AS peak FROM logs")
def p22(s, d):
    from .operators.clean import interpolated_peaks

    return rounded(interpolated_peaks(synthesis.synthesise(synthesis.spectra(cube(s, d), N_CHAN), AXES, "ri", precision="double"), RM), "rm_peak", "peak")


@query("r2_bandpass_flags")
def r2(s, d):
    from .operators.fitting import bandpass_flags

    return bandpass_flags(cube(s, d).select("x", "y", "chan", "q"), ["x", "y"], "chan", "q", 0.0)


@query("w1_moving_median", _with(_CUBE) + """, v AS (SELECT x, y, list(i ORDER BY chan) AS v, list(chan ORDER BY chan) AS c FROM cube GROUP BY 1, 2),
m AS (SELECT x, y, v, c, [list_sort(v[4 * b + 1 : 4 * b + 8])[5] FOR b IN range(greatest((len(v) - 8) // 4 + 1, 0))] AS med FROM v),
e AS (SELECT *, CASE WHEN len(med) = 0 THEN 0 ELSE 4 * len(med) + 4 END AS done FROM m)
SELECT x, y, unnest(c) AS chan, unnest(v) AS i, round(unnest([CASE WHEN p < done THEN list_avg([med[b + 1] FOR b IN range(len(med)) IF 4 * b <= p AND p < 4 * b + 8]) ELSE list_sort(v[done + 1 :])[(len(v) - done) // 2 + 1] END FOR p IN range(len(v))]), 6) AS fit FROM e""")
def w1(s, d):
    from .operators.fitting import median_smoothed

    return rounded(median_smoothed(cube(s, d), ["x", "y"], "chan", "i", 8, 4), "fit")


@query("w2_moving_fit")
def w2(s, d):
    from .operators.fitting import fitted

    return fitted(cube(s, d), ["x", "y"], "chan", "i", window=32)


#: Power of every plane by the sums that define it; (kx, ky): frequencies from 0.
_POWER = """extent AS (SELECT chan AS irm, min(x) AS x0, max(x) - min(x) + 1 AS nx, min(y) AS y0, max(y) - min(y) + 1 AS ny FROM planes GROUP BY 1),
waves AS (SELECT irm, x0, nx, y0, ny, kx, ky, val, 2 * pi() * (kx * (x - x0) / CAST(nx AS DOUBLE) + ky * (y - y0) / CAST(ny AS DOUBLE)) AS arg FROM extent JOIN planes ON chan = irm JOIN (SELECT range AS kx FROM range(8)) ON kx < nx JOIN (SELECT range AS ky FROM range(8)) ON ky < ny),
power AS (SELECT irm, x0, nx, y0, ny, kx, ky, CASE WHEN kx = 0 AND ky = 0 THEN 0 ELSE (pow(sum(val * cos(arg)), 2) + pow(sum(val * sin(arg)), 2)) / pow(nx * ny, 2) END AS p FROM waves GROUP BY irm, x0, nx, y0, ny, kx, ky)"""


@query("x15_power_spectrum", _with(_PLANES, _POWER) + "SELECT irm, CAST((kx + nx // 2) % nx + x0 AS INT) AS x, CAST((ky + ny // 2) % ny + y0 AS INT) AS y, pow(round(sqrt(p), 6), 2) AS val FROM power")
def x15(s, d):
    from .operators.fourier import power_spectra

    # powers of integers over 64 pixels may lie half-way between decimals, their roots don't
    root = F.round(F.sqrt("val"), 6)
    return power_spectra(planes(s, d).withColumnRenamed("chan", "irm")).withColumn("val", root * root)


@query("x15_autocorrelation", _with(_PLANES, _POWER) + """SELECT irm, CAST((lx + nx // 2) % nx + x0 AS INT) AS x, CAST((ly + ny // 2) % ny + y0 AS INT) AS y, round(sum(p * cos(2 * pi() * (kx * lx / CAST(nx AS DOUBLE) + ky * ly / CAST(ny AS DOUBLE)))), 6) + 0.0 AS val
FROM power JOIN (SELECT range AS lx FROM range(8)) ON lx < nx JOIN (SELECT range AS ly FROM range(8)) ON ly < ny GROUP BY irm, x0, nx, y0, ny, lx, ly""")
def x15_auto(s, d):
    from .operators.fourier import autocorrelations

    return rounded(autocorrelations(planes(s, d).withColumnRenamed("chan", "irm")), "val")


@query("s8_run_log", _with(_LOG) + "SELECT date_trunc('millisecond', ts) AS ts, 'info' AS level, stage, tid, event, CAST(event_id % 50 AS INT) AS y_beg, bytes, CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 3 AS INT) END AS slot FROM (SELECT event_id, ts, stage, tid, CASE WHEN event_id % 5 = 0 THEN 'enqueue' ELSE event END AS event, CASE WHEN event_id % 5 = 0 THEN NULL ELSE bytes END AS bytes FROM ev)".replace("CAST(event_id % 50 AS INT) AS y_beg", "CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 50 AS INT) END AS y_beg"))
def s8(s, d):
    e = log_events(s, d)
    span = F.format_string("%s tile x:[1,10] y:[%d,%d] bytes=%d", "event", F.col("event_id") % 50, F.col("event_id") % 50 + 9, "bytes")
    message = F.when(F.col("event_id") % 5 == 0, F.format_string("async enqueue compute slot=%d sub=1", F.col("event_id") % 3)).otherwise(span)
    lines = e.select(F.format_string("%s [info] [%s] [tid=%d] %s", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), "stage", "tid", message).alias("value"))
    return runlog.parse(lines).select("ts", "level", "stage", "tid", "event", "y_beg", "bytes", "slot")


# -- FITS files: the cube is written, read and run through; maps come back from the products


def _fits(spark: SparkSession, d: str, extra: str = "", bitpix: int = -32) -> str:
    """A folder that driver and executors share, with the cube as Q.FITS and U.FITS and a configuration run.cfg."""
    import os
    import tempfile
    import uuid

    from .sources import fits

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    shared = shared or tempfile.gettempdir()
    if ":/" in shared and not shared.startswith("file:/"):
        raise ValueError(f"FITS files are read and written by byte ranges, which {shared} doesn't offer")
    folder = os.path.join("/" + shared.removeprefix("file:").lstrip("/"), f"faradeon-fits-{uuid.uuid4().hex}")
    os.makedirs(folder)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{folder}")
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    fits.register(spark)
    cards = {"CTYPE1": "RA---SIN", "CTYPE2": "DEC--SIN", "CTYPE3": "FREQ", "CRVAL3": float(FREQ[0]), "CRPIX3": 1.0, "CDELT3": float(FREQ[1] - FREQ[0]), "CRVAL1": 10.0, "CRVAL2": -30.0, "CRPIX1": 1.0, "CRPIX2": 1.0, "CDELT1": -0.01, "CDELT2": 0.01}
    masked = lambda c: F.zip_with(c, "w", lambda v, w: F.when(w > 0, v).otherwise(F.lit(mask.SENTINEL))).alias(c)
    rows = synthesis.spectra(cube(spark, d), N_CHAN).select((F.col("x") + 1).alias("x"), (F.col("y") + 1).alias("y"), masked("q"), masked("u"))
    products = [{"path": f"{folder}/{c.upper()}.FITS", "column": c, "naxes": [5, 5, N_CHAN], "bitpix": bitpix, "cards": cards} for c in "qu"]
    rows.write.format("fits_output").mode("append").option("products", json.dumps(products)).save()
    with open(f"{folder}/bad.txt", "w", encoding="utf-8") as f:
        f.writelines(f"{b + 1}\n" for b in BAD)
    with open(f"{folder}/run.cfg", "w", encoding="utf-8") as f:
        f.write(RUN.format(d=folder) + extra)
    return folder


RUN = """path = {d}
infileq = Q.FITS
infileu = U.FITS
outfile = {d}/out
remove_badchan = y
global_badchan_file = {d}/bad.txt
subim = n
rem_mean = 0
remove_qu_bias = n
resiQ = 0
slopeQ = 0
resiU = 0
slopeU = 0
ofac = 1
fac = 3.14159265
use_auto_rm_range = 0
beg_rm = -40
end_rm = 40
nrm = 41
cubestat = y
"""


def _map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("fits_image").option("path", path).load().select((F.col("x") - 1).alias("x"), (F.col("y") - 1).alias("y"), "val")


@query("s2_fits_cube", _with(_CUBE) + "SELECT x, y, CAST((chan - 4) // 3 AS INT) AS k, round(q, 3) + 0.0 AS q FROM cube WHERE w = 1 AND x BETWEEN 1 AND 3 AND chan BETWEEN 4 AND 49 AND (chan - 4) % 3 = 0")
def s2(s, d):
    folder = _fits(s, d)
    reader = s.read.format("fits_cube").option("q", f"{folder}/Q.FITS").option("u", f"{folder}/U.FITS")
    for k, v in {"x_first": 2, "x_last": 4, "chan_first": 5, "chan_last": 50, "chan_step": 3}.items():
        reader = reader.option(k, v)
    rows = reader.load().select((F.col("x") + 0).cast("int").alias("x"), (F.col("y") - 1).cast("int").alias("y"), F.posexplode("q").alias("k", "q"))
    return rounded(rows.where(F.col("q") > mask.SENTINEL + 1).withColumn("q", F.col("q").cast("double")), "q", n=3)


@query("k5_committed_cube", _with(_CUBE) + "SELECT x, y, chan, round(q, 3) + 0.0 AS q, round(u, 3) + 0.0 AS u, true AS q_sum_ok, true AS u_sum_ok FROM cube WHERE w = 1")
def k5(s, d):
    """All samples of the committed files, and whether their data sums, taken again, are those in their headers."""
    from .sources import fits

    folder = _fits(s, d)
    rows = s.read.format("fits_cube").option("q", f"{folder}/Q.FITS").option("u", f"{folder}/U.FITS").load()
    long = rows.select((F.col("x") - 1).alias("x"), (F.col("y") - 1).alias("y"), F.posexplode(F.arrays_zip("q", "u")).alias("chan", "v")).select("x", "y", "chan", "v.q", "v.u")
    for k in "qu":
        long = long.crossJoin(F.broadcast(fits.verified(s, f"{folder}/{k.upper()}.FITS").select(F.col("ok").alias(f"{k}_sum_ok"))))  # one row
    return rounded(long.where(F.col("q") > mask.SENTINEL + 1), "q", "u", n=3)


@query("k1_strip_cube", _with(_CUBE, _AXES, _FAR) + "SELECT x, y, irm, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM far WHERE y IN (2, 3) AND x >= 1")
def k1(s, d):
    """A strip of a Faraday cube that a run has written as Parquet by strips of the sky."""
    from .plans import config, pipeline
    from .sources.strips import read_strips

    folder = _fits(s, d, "output_mode = ri\n", -64)
    path = pipeline.run_strips(s, config.load(f"{folder}/run.cfg"), f"{folder}/strips", rows=2, precision="double")
    rows = read_strips(s, path, x=(2, 5), y=(3, 4)).select((F.col("x") - 1).alias("x"), (F.col("y") - 1).alias("y"), F.posexplode(F.arrays_zip("re", "im")).alias("irm", "v"))
    return rounded(rows.select("x", "y", "irm", *(C.nan_to_null(F.col(f"v.{c}")).alias(c) for c in ("re", "im"))), "re", "im")


@query("k4_run_maps", _with(_CUBE, _AXES, _FAR, _TAIL) + "SELECT x, y, nvalid, round(peak, 6) AS peak, rm_peak, round(cos(ang), 5) + 0.0 AS c, round(sin(ang), 5) + 0.0 AS s, round(peak / greatest(CASE WHEN q50 - q16 > 0 THEN (q50 - q16) / 0.67449 ELSE 1.4826 * mad END, 1e-12), 4) AS snr FROM h JOIN (SELECT x, y, arg_max(ang, amp) AS ang, CAST(max(w) AS INT) AS nvalid FROM lng GROUP BY 1, 2) USING (x, y)")
def k4_maps(s, d):
    """All maps of a run from files: counts, peaks, their depths and angles, and signal to noise."""
    from .plans import config, pipeline
    from .sources.strips import read_strips

    folder = _fits(s, d, bitpix=-64)
    path = pipeline.run_strips(s, config.load(f"{folder}/run.cfg"), f"{folder}/strips", rows=2, precision="double")
    rows = read_strips(s, path).select((F.col("x") - 1).alias("x"), (F.col("y") - 1).alias("y"), "nvalid", "peak", F.round("rm_peak", 9).alias("rm_peak"), F.cos("ang_peak").alias("c"), F.sin("ang_peak").alias("s"), "snr")
    return rounded(rounded(rounded(rows, "peak"), "c", "s", n=5), "snr", n=4)


@query("k3_run_nvalid", _with(_CUBE) + "SELECT x, y, CAST(sum(w) AS DOUBLE) AS nvalid FROM cube GROUP BY 1, 2")
def k3(s, d):
    from .plans import config, pipeline

    targets = pipeline.run(s, config.load(f"{_fits(s, d)}/run.cfg"))
    return _map(s, targets["nvalid"]).select("x", "y", F.col("val").cast("double").alias("nvalid"))


@query("k4_run_peaks", _with(_CUBE, _AXES, _FAR) + "SELECT x, y, round(max(amp), 2) AS peak FROM lng GROUP BY 1, 2")
def k4(s, d):
    from .plans import config, pipeline

    targets = pipeline.run(s, config.load(f"{_fits(s, d)}/run.cfg"))
    return rounded(_map(s, targets["peak"]).select("x", "y", F.col("val").cast("double").alias("peak")), "peak", n=2)


@query("w6_shift_2d", _with(_IMG) + "SELECT CAST((x + 16) % 32 AS INT) AS x, CAST((y + 16) % 32 AS INT) AS y, round(val, 6) AS val FROM img")
def w6_2d(s, d):
    return rounded(images.half_shifted(image(s, d), 32, 32), "val")


_SKY = "sky AS (SELECT o_orderkey, (o_orderkey % 360) * pi() / 180 AS ra, (o_orderkey % 120 - 60) * pi() / 180 AS de, 2451545.0 + o_orderkey % 10000 AS jd FROM orders)"


def _sky(s, d):
    k = F.col("o_orderkey")
    return read(s, d, "orders").select("o_orderkey", F.radians((k % 360).cast("double")).alias("ra"), F.radians((k % 120 - 60).cast("double")).alias("de"), (k % 10000 + 2451545.0).alias("jd"))


@query("x19_greenwich_sidereal", _with(_SKY) + "SELECT o_orderkey, round(g - 360 * floor(g / 360), 5) AS gmst FROM (SELECT o_orderkey, 280.46061837 + 360.98564736629 * (jd - 2451545.0) + 0.000387933 * pow((jd - 2451545.0) / 36525.0, 2) - pow((jd - 2451545.0) / 36525.0, 3) / 38710000.0 AS g FROM sky)")
def x19_gmst(s, d):
    return rounded(_sky(s, d).select("o_orderkey", C.greenwich_sidereal_degrees("jd").alias("gmst")), "gmst", n=5)


_SEEN = """seen AS (SELECT o_orderkey, cos(0.5) * cos(za) - sin(0.5) * sin(za) * cos(az) AS m, -sin(za) * sin(az) AS w, sin(0.5) * cos(za) + cos(0.5) * sin(za) * cos(az) AS n FROM
  (SELECT o_orderkey, radians(o_orderkey % 360) AS az, radians(o_orderkey % 80 + 5) AS za FROM orders))"""


@query("x19_equatorial", _with(_SEEN) + "SELECT o_orderkey, round(cos(2.0) * m + sin(2.0) * w, 6) + 0.0 AS x, round(sin(2.0) * m - cos(2.0) * w, 6) + 0.0 AS y, round(n, 6) + 0.0 AS z, round(cos(1.1) * m - sin(1.1) * w, 6) + 0.0 AS t FROM seen")
def x19_equatorial(s, d):
    """Directions on the sky turned to right ascension and declination, and the sidereal time at which a source stands there;
    SQL turns the vectors."""
    k = F.col("o_orderkey")
    seen = read(s, d, "orders").select("o_orderkey", F.radians((k % 360).cast("double")).alias("az"), F.radians((k % 80 + 5).cast("double")).alias("za"))
    ra, de = C.equatorial("az", "za", F.lit(0.5), F.lit(2.0))
    lst = C.sidereal_time("az", "za", F.lit(0.5), F.lit(1.1))
    found = seen.select("o_orderkey", ra.alias("ra"), de.alias("de"), lst.alias("lst"))
    return rounded(found.select("o_orderkey", (F.cos("de") * F.cos("ra")).alias("x"), (F.cos("de") * F.sin("ra")).alias("y"), F.sin("de").alias("z"), (F.cos("de") * F.cos("lst")).alias("t")), "x", "y", "z", "t")


#: Newcomb's angles from 1950 to 2000 by their polynomials (seconds of arc), half a century from 1900 and half a century long.
_NEWCOMB = """turn AS (SELECT radians(((2304.250 + 1.396 * 0.5) * 0.5 + 0.302 * 0.25 + 0.018 * 0.125) / 3600) AS zeta, radians(((2304.250 + 1.396 * 0.5) * 0.5 + 1.093 * 0.25 + 0.018 * 0.125) / 3600) AS z,
  radians(((2004.682 - 0.853 * 0.5) * 0.5 - 0.426 * 0.25 - 0.042 * 0.125) / 3600) AS theta),
turned AS (SELECT o_orderkey, z, cos(de) * sin(ra + zeta) AS a, cos(theta) * cos(de) * cos(ra + zeta) - sin(theta) * sin(de) AS b, sin(theta) * cos(de) * cos(ra + zeta) + cos(theta) * sin(de) AS c FROM sky CROSS JOIN turn)"""


@query("x19_precession_fk4", _with(_SKY, _NEWCOMB) + "SELECT o_orderkey, round(b * cos(z) - a * sin(z), 9) + 0.0 AS x, round(a * cos(z) + b * sin(z), 9) + 0.0 AS y, round(c, 9) + 0.0 AS z FROM turned")
def x19_precession(s, d):
    """Unit vectors of precessed places."""
    ra, de = C.precessed("ra", "de", 1950.0, 2000.0, "FK4")
    v = _sky(s, d).select("o_orderkey", ra.alias("ra"), de.alias("de"))
    return rounded(v.select("o_orderkey", (F.cos("de") * F.cos("ra")).alias("x"), (F.cos("de") * F.sin("ra")).alias("y"), F.sin("de").alias("z")), "x", "y", "z", n=9)


@query("p19_clean_q")
def p19(s, d):
    from .operators.clean import clean_spectra

    return clean_spectra(synthesis.spectra(cube(s, d), N_CHAN), AXES, stokes="Q", niter=50)


#: Mean over each channel's width by Simpson's rule on 64 intervals, of the phase's series to the third order.
_LOSS = """node AS (SELECT (range - 32) / 64.0 * 4.0 AS d, CASE WHEN range IN (0, 64) THEN 1 WHEN range % 2 = 1 THEN 4 ELSE 2 END / 192.0 AS g FROM range(65)),
share AS (SELECT chan, freq, lsq, pow(freq, -1.5) / (SELECT sum(pow(freq, -1.5)) FROM chans WHERE chan NOT IN (11, 31)) AS h FROM chans WHERE chan NOT IN (11, 31)),
loss AS (SELECT irm, sum(h * g * cos(2 * rm * e)) AS b, sum(h * g * sin(2 * rm * e)) AS c FROM (SELECT h, g, lsq * (-2 * (d / freq) + 3 * pow(d / freq, 2) - 4 * pow(d / freq, 3)) AS e FROM share CROSS JOIN node) CROSS JOIN depths GROUP BY 1)"""


@query("p21_depolarisation", _with(_CUBE, _AXES, _FAR, _LOSS) + "SELECT x, y, irm, round((re * b + im * c) / (b * b + c * c), 6) + 0.0 AS re, round((im * b - re * c) / (b * b + c * c), 6) + 0.0 AS im FROM far JOIN loss USING (irm)")
def p21(s, d):
    from .operators.clean import depolarisation_corrected

    arrays = depolarisation_corrected(synthesis.synthesise(synthesis.spectra(cube(s, d), N_CHAN), AXES, "ri", precision="double"), AXES, 4.0)
    rows = synthesis.exploded(arrays, AXES.depths(s)).select("x", "y", "irm", "re", "im")
    return rounded(rows.withColumns({c: C.nan_to_null(c) for c in ("re", "im")}), "re", "im")


@query("r3_significant_pixels", _with(_CUBE) + "SELECT x, y, chan, round(lp, 6) AS lp FROM (SELECT *, sqrt(q * q + u * u) AS lp FROM cube WHERE w = 1) JOIN (SELECT x, y, avg(sqrt(q * q + u * u)) + 2 * stddev_pop(sqrt(q * q + u * u)) AS cut FROM cube WHERE w = 1 GROUP BY 1, 2) USING (x, y) WHERE lp > cut")
def r3(s, d):
    rows = images.long_form(cube(s, d))
    w = Window.partitionBy("x", "y")
    cut = F.avg("lp").over(w) + 2 * F.stddev_pop("lp").over(w)
    return rounded(rows.withColumn("cut", cut).where("lp > cut").select("x", "y", "chan", "lp"), "lp")


# -- the same by functions called from SQL


def _samples_view(s, d) -> str:
    """Name of a view of the samples with their wavelengths squared; the functions are known to the session after it."""
    from .functions import sql

    sql.register(s)
    cube(s, d).join(F.broadcast(AXES.channels(s).select("chan", "lsq")), "chan").select("chan", "x", "y", "u", "q", "w", "lsq").createOrReplaceTempView("faradeon_samples")
    return "faradeon_samples"


_AXIS = "beg => -40D, end => 40D, n => 41"


@query("sql_rm_synthesis", _SPECTRUM)
def sql_synthesis(s, d):
    rows = s.sql(f"SELECT x, y, irm, rm, re, im FROM rm_synthesis(TABLE({_samples_view(s, d)}) PARTITION BY (x, y), {_AXIS})")
    return rounded(rows, "re", "im")


@query("sql_peak_map", _with(_CUBE, _AXES, _FAR, _TAIL) + "SELECT x, y, round(peak, 5) AS peak, rm_peak, round(peak / greatest(CASE WHEN q50 - q16 > 0 THEN (q50 - q16) / 0.67449 ELSE 1.4826 * mad END, 1e-12), 4) AS snr FROM h")
def sql_peaks(s, d):
    rows = s.sql(f"SELECT x, y, peak, rm_peak, snr FROM peak_map(TABLE(SELECT * FROM rm_synthesis(TABLE({_samples_view(s, d)}) PARTITION BY (x, y), {_AXIS})) PARTITION BY (x, y)) WHERE peak IS NOT NULL")
    return rounded(rounded(rows, "peak", n=5), "snr", n=4)


@query("sql_rm_clean", _cleaned_sql(3))
def sql_clean(s, d):
    names = ("component_re", "component_im", "re", "im")
    rows = s.sql(f"SELECT x, y, irm, {', '.join(names)} FROM rm_clean(TABLE({_samples_view(s, d)}) PARTITION BY (x, y), {_AXIS}, threshold => 0.5D, niter => 3)")
    return rounded(rows, *names)


@query("sql_scalar_functions", _with(_CUBE, _AXES) + "SELECT x, y, chan, round(sqrt(q * q + u * u), 6) AS amp, round(cos(2 * (0.5 * atan2(u, q))), 6) + 0.0 AS c, round(lsq, 9) AS lsq, round(sqrt(q * q + u * u) / i, 9) AS p FROM cube JOIN chans USING (chan) WHERE w = 1")
def sql_scalars(s, d):
    from .functions import sql

    sql.register(s)
    cube(s, d).join(F.broadcast(AXES.channels(s).select("chan", "freq")), "chan").createOrReplaceTempView("faradeon_cube")
    rows = s.sql("SELECT x, y, chan, amplitude(q, u) AS amp, cos(2 * pol_angle(q, u)) AS c, lambda_squared(freq) AS lsq, fractional_polarisation(q, u, i) AS p FROM faradeon_cube WHERE w = 1")
    return rounded(rounded(rows, "amp", "c"), "lsq", "p", n=9)


# -- Fourier transforms of lines and planes, convolution, alignment


_WAVE = "2 * pi() * k * chan / 64.0"


@query("x14_fourier_lines", _with(_CUBE) + f"SELECT x, y, CAST(k AS INT) AS chan, round(sum(q * cos({_WAVE}) + u * sin({_WAVE})), 6) + 0.0 AS re, round(sum(u * cos({_WAVE}) - q * sin({_WAVE})), 6) + 0.0 AS im FROM cube CROSS JOIN (SELECT range AS k FROM range(64)) GROUP BY 1, 2, 3")
def x14_lines(s, d):
    """Lines longer than a task may hold (16 points here), in four steps."""
    from .operators.transforms import fourier

    return rounded(fourier(cube(s, d), ["x", "y"], "chan", 64, "q", "u", line=16), "re", "im")


@query("x14_fourier_inverse", _with(_CUBE) + f"SELECT x, y, CAST(k AS INT) AS chan, round(sum(q * cos({_WAVE}) - u * sin({_WAVE})) / 64, 6) + 0.0 AS re, round(sum(u * cos({_WAVE}) + q * sin({_WAVE})) / 64, 6) + 0.0 AS im FROM cube CROSS JOIN (SELECT range AS k FROM range(64)) GROUP BY 1, 2, 3")
def x14_inverse(s, d):
    from .operators.transforms import fourier

    return rounded(fourier(cube(s, d), ["x", "y"], "chan", 64, "q", "u", inverse=True), "re", "im")


_FOURIER = """wave AS (SELECT chan, kx, ky, sum(val * cos(2 * pi() * (kx * x + ky * y) / 8.0)) AS re, -sum(val * sin(2 * pi() * (kx * x + ky * y) / 8.0)) AS im FROM planes CROSS JOIN (SELECT range AS kx FROM range(8)) CROSS JOIN (SELECT range AS ky FROM range(8)) GROUP BY 1, 2, 3)"""


@query("x14_fourier_planes", _with(_PLANES, _FOURIER) + "SELECT chan, CAST(kx AS INT) AS x, CAST(ky AS INT) AS y, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM wave")
def x14_planes(s, d):
    from .operators.transforms import fourier_2d

    return rounded(fourier_2d(planes(s, d), ["chan"], 8, 8, "val", None), "re", "im", n=5)


@query("x18_offsets", _with(_PLANES) + """SELECT chan, CAST(arg_max(((lx + 4) % 8) - 4, c) AS INT) AS dx, CAST(arg_max(((ly + 4) % 8) - 4, c) AS INT) AS dy FROM (
  SELECT a.chan, (a.x - (b.x + b.chan) % 8 + 8) % 8 AS lx, (a.y - (b.y + 3 * b.chan) % 8 + 8) % 8 AS ly, sum(a.val * b.val) AS c FROM planes a JOIN planes b USING (chan) GROUP BY 1, 2, 3) GROUP BY 1""")
def x18(s, d):
    """By how much planes that were moved around their edges must move back; SQL sums the correlation itself."""
    from .operators.transforms import offsets

    a = planes(s, d)
    b = a.select("chan", ((F.col("x") + F.col("chan")) % 8).alias("x"), ((F.col("y") + 3 * F.col("chan")) % 8).alias("y"), "val")
    return offsets(a, b, ["chan"], 8, 8)


@query("x18_moved", _with(_PLANES, _FOURIER) + """, turned AS (SELECT chan, kx, ky, re, im, -2 * pi() * (CASE WHEN kx <= 4 THEN kx ELSE kx - 8 END * 0.25 * chan + CASE WHEN ky <= 4 THEN ky ELSE ky - 8 END * -1.5) / 8.0 AS p FROM wave)
SELECT chan, CAST(x AS INT) AS x, CAST(y AS INT) AS y, round(sum((re * cos(p) - im * sin(p)) * cos(2 * pi() * (kx * x + ky * y) / 8.0) - (re * sin(p) + im * cos(p)) * sin(2 * pi() * (kx * x + ky * y) / 8.0)) / 64, 5) + 0.0 AS val FROM turned CROSS JOIN (SELECT range AS x FROM range(8)) CROSS JOIN (SELECT range AS y FROM range(8)) GROUP BY 1, 2, 3""")
def x18_moved(s, d):
    from .operators.transforms import moved

    p = planes(s, d)
    shifts = p.select("chan").distinct().select("chan", (F.col("chan") * 0.25).alias("dx"), F.lit(-1.5).alias("dy"))
    return rounded(moved(p, shifts, ["chan"], 8, 8), "val", n=5)


@query("x16_convolved", """WITH t AS (SELECT unnest([0, 1, 2, 3, 4]) AS k, unnest([0.25, 0.5, -1.0, 2.0, 0.125]) AS w)
SELECT CAST(user_id % 4 AS INT) AS tid, event_id + k AS event_id, round(sum(value * w), 6) + 0.0 AS value FROM events CROSS JOIN t GROUP BY 1, 2""")
def x16(s, d):
    """Series of four logs over ranges of 100 places; what a range needs of the one before comes as its halo."""
    from .operators.transforms import convolved

    e = read(s, d, "events").select((F.col("user_id") % 4).cast("int").alias("tid"), "event_id", "value")
    return rounded(convolved(e, ["tid"], "event_id", "value", [0.25, 0.5, -1.0, 2.0, 0.125], block=100), "value")


# -- scans, sums that merge, random columns, matrices


@query("p5_bias_stateful", _with(_CUBE) + """SELECT x, y, chan, round(q - (i * 0.01 * CASE WHEN turns_q % 2 = 0 THEN 1 ELSE -1 END + 0.5), 6) + 0.0 AS q, round(u - (i * 0.02 * CASE WHEN turns_u % 2 = 0 THEN 1 ELSE -1 END - 0.25), 6) + 0.0 AS u FROM (
  SELECT *, sum(CASE WHEN q >= 0.5 THEN 0 ELSE 1 END) OVER w AS turns_q, sum(CASE WHEN u >= -0.25 THEN 0 ELSE 1 END) OVER w AS turns_u FROM cube WHERE w = 1 WINDOW w AS (ORDER BY y, x, chan DESC ROWS UNBOUNDED PRECEDING))""")
def p5_stateful(s, d):
    """The published form, whose sign carries over from sample to sample and pixel to pixel."""
    from .operators.scan import bias_corrected

    c = cube(s, d).where("w = 1").select("x", "y", "chan", "q", "u", "i")
    return rounded(bias_corrected(c, {"q": (0.01, 0.5), "u": (0.02, -0.25)}).drop("i"), "q", "u")


_MD5 = "CAST('0x' || substr(md5('7:k' || o_orderkey || ':k' || o_custkey), {}, 13) AS BIGINT) / 4503599627370496.0"


@query("x20_random", f"SELECT o_orderkey, round({_MD5.format(1)}, 9) AS u, round(sqrt(-2 * ln(1 - {_MD5.format(1)})) * cos(2 * pi() * {_MD5.format(14)}), 9) + 0.0 AS n, round(o_totalprice + 3 * sqrt(-2 * ln(1 - {_MD5.format(1)})) * cos(2 * pi() * {_MD5.format(14)}), 6) AS noisy FROM orders")
def x20(s, d):
    keys = ("o_orderkey", "o_custkey")
    rows = read(s, d, "orders").repartition(7).select("o_orderkey", C.uniform(7, *keys).alias("u"), C.normal(7, *keys).alias("n"), C.noisy("o_totalprice", 3.0, 7, *keys).alias("noisy"))
    return rounded(rounded(rows, "u", "n", n=9), "noisy")


def _tables_of(s, d) -> tuple[DataFrame, DataFrame]:
    """Two sets of matrices by return flag: 20 by 30 and 30 by 7."""
    li = read(s, d, "lineitem")
    of = lambda i, n, j, m, v: li.groupBy("l_returnflag", (F.col(i) % n).cast("int").alias("i"), (F.col(j) % m).cast("int").alias("j")).agg(F.sum(v).alias("v"))
    return of("l_suppkey", 20, "l_partkey", 30, "l_discount"), of("l_partkey", 30, "l_linenumber", 7, "l_tax")


@query("x13_product", "WITH a AS (SELECT l_returnflag, l_suppkey % 20 AS i, l_partkey % 30 AS k, sum(l_discount) AS v FROM lineitem GROUP BY 1, 2, 3), b AS (SELECT l_returnflag, l_partkey % 30 AS k, l_linenumber % 7 AS j, sum(l_tax) AS v FROM lineitem GROUP BY 1, 2, 3) SELECT l_returnflag, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(sum(a.v * b.v), 5) AS v FROM a JOIN b USING (l_returnflag, k) GROUP BY 1, 2, 3")
def x13(s, d):
    from .operators.matrices import product

    return rounded(product(*_tables_of(s, d), ["l_returnflag"], block=8), "v", n=5)


_TWO = "SELECT l_suppkey, sum(l_quantity) AS a, sum(l_discount) AS b, sum(l_tax) AS c, CAST(count(*) AS DOUBLE) AS d FROM lineitem GROUP BY 1"


@query("x13_inverse", f"SELECT l_suppkey, CAST(k // 2 AS INT) AS i, CAST(k % 2 AS INT) AS j, round(CASE k WHEN 0 THEN d WHEN 1 THEN -b WHEN 2 THEN -c ELSE a END / (a * d - b * c), 9) + 0.0 AS v FROM ({_TWO}) CROSS JOIN (SELECT range AS k FROM range(4))")
def x13_inverse(s, d):
    from .operators.matrices import inverse

    two = read(s, d, "lineitem").groupBy("l_suppkey").agg(F.array(F.sum("l_quantity"), F.sum("l_discount"), F.sum("l_tax"), F.count("*").cast("double")).alias("m"))
    rows = two.select("l_suppkey", F.posexplode("m").alias("p", "v")).select("l_suppkey", F.floor(F.col("p") / 2).cast("int").alias("i"), (F.col("p") % 2).cast("int").alias("j"), "v")
    return rounded(inverse(rows, 2, ["l_suppkey"]), "v", n=9)


#: Gauss and Jordan's elimination of each row's augmented matrix m of {n} rows, step by step.
_SOLVED = """solved AS (SELECT {keys}, 0 AS step, m FROM gram UNION ALL
  SELECT {keys}, step + 1, [CASE WHEN i = step + 1 THEN [v / m[step + 1][step + 1] FOR v IN m[step + 1]] ELSE [m[i][j] - m[i][step + 1] * m[step + 1][j] / m[step + 1][step + 1] FOR j IN range(1, {n} + 2)] END FOR i IN range(1, {n} + 1)] FROM solved WHERE step < {n})"""
_SERIES = """point AS (SELECT x, y, chan, i, 2 * (chan - a) / CASE WHEN b > a THEN b - a ELSE 1.0 END - 1 AS s FROM cube JOIN (SELECT x, y, min(chan) AS a, max(chan) AS b FROM cube GROUP BY 1, 2) USING (x, y)),
base AS (SELECT x, y, chan, i, [1, s, s * s, s * s * s, cos(pi() * (s + 1)), sin(pi() * (s + 1)), cos(2 * pi() * (s + 1)), sin(2 * pi() * (s + 1)), cos(3 * pi() * (s + 1)), sin(3 * pi() * (s + 1)), i] AS e FROM point),
cell AS (SELECT x, y, p, r, sum(e[p] * e[r]) AS v FROM base CROSS JOIN (SELECT unnest(range(1, 11)) AS p) CROSS JOIN (SELECT unnest(range(1, 12)) AS r) GROUP BY 1, 2, 3, 4),
gram AS (SELECT x, y, list(row ORDER BY p) AS m FROM (SELECT x, y, p, list(v ORDER BY r) AS row FROM cell GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query("r1_outliers", "WITH RECURSIVE " + ",\n".join([_CUBE, _SERIES, _SOLVED.format(keys="x, y", n=10)]) + """, off AS (SELECT x, y, chan, i, i - list_sum([e[k] * m[k][11] FOR k IN range(1, 11)]) AS residual FROM base JOIN solved USING (x, y) WHERE step = 10)
SELECT x, y, chan, round(i, 6) AS i, round(residual, 4) + 0.0 AS residual FROM off JOIN (SELECT x, y, sqrt(avg(residual * residual)) AS rms FROM off GROUP BY 1, 2) USING (x, y) WHERE abs(residual) > 2 * rms""")
def r1(s, d):
    """Channels far from a fit by merged sums; SQL eliminates the same normal equations."""
    from .operators.least_squares import residual_outliers

    return rounded(rounded(residual_outliers(cube(s, d), ["x", "y"], "chan", "i").select("x", "y", "chan", "i", "residual"), "i"), "residual", n=4)


@query("x17_plane_fits", "WITH RECURSIVE " + ",\n".join([_PLANES, """point AS (SELECT chan, [1, x, y, x * y, val] AS e FROM planes),
cell AS (SELECT chan, p, r, sum(e[p] * e[r]) AS v FROM point CROSS JOIN (SELECT unnest(range(1, 5)) AS p) CROSS JOIN (SELECT unnest(range(1, 6)) AS r) GROUP BY 1, 2, 3),
gram AS (SELECT chan, list(row ORDER BY p) AS m FROM (SELECT chan, p, list(v ORDER BY r) AS row FROM cell GROUP BY 1, 2) GROUP BY 1)""", _SOLVED.format(keys="chan", n=4)]) + " SELECT chan, round(m[1][5], 5) + 0.0 AS c0, round(m[2][5], 5) + 0.0 AS c1, round(m[3][5], 5) + 0.0 AS c2, round(m[4][5], 5) + 0.0 AS c3 FROM solved WHERE step = 4")
def x17_planes(s, d):
    from .operators.least_squares import least_squares

    x, y = F.col("x"), F.col("y")
    fit = least_squares(planes(s, d), ["chan"], [F.lit(1.0), x, y, x * y], F.col("val"))
    return rounded(fit.select("chan", *(F.col("coefficients")[k].alias(f"c{k}") for k in range(4))), "c0", "c1", "c2", "c3", n=5)


@query("x17_ellipses")
def x17_ellipses(s, d):
    """Ellipses through all of a log's points, laid on an ellipse of the log's own with the events' values as noise."""
    from .operators.least_squares import ellipses

    e, t = read(s, d, "events"), F.col("event_id") * 0.37
    tid, off = F.col("user_id") % 4, (F.col("value") % 1 - 0.5) * 0.02
    px, py = (5 + tid) * F.cos(t) * (1 + off), (2 + 0.5 * tid) * F.sin(t) * (1 + off)
    points = e.select(tid.cast("int").alias("tid"), (10 * tid + px * F.cos(F.lit(0.4)) - py * F.sin(F.lit(0.4))).alias("x"), (px * F.sin(F.lit(0.4)) + py * F.cos(F.lit(0.4)) - tid).alias("y"))
    return ellipses(points, ["tid"])
