"""Operators against NumPy models and analytic cases."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faradeon.functions import axes, generators
from faradeon.functions import columns as C
from faradeon.functions.axes import Axes, rm_axis
from faradeon.operators import clean, cubestat, fitting, fourier, images, mask, runlog, statistics, synthesis


@pytest.fixture(scope="module")
def sources():
    freq, q, u = generators.two_sources()
    return Axes.of(freq, rm_axis(-50.0, 50.0, 201)), q.reshape(200, -1).T, u.reshape(200, -1).T


def test_two_sources_peak_at_their_depths(sources):
    ax, q, u = sources
    re, im, n = synthesis.transform(q, u, np.ones_like(q), ax)
    peak, rm, ang, snr = cubestat.peak_of(np.hypot(re, im), np.arctan2(im, re), ax.rm)
    for (x, y), r, p, a in (((12, 10), -5.0, 1.0, 0.0), ((22, 20), 22.0, 0.8, np.radians(60))):
        k = y * 32 + x
        assert rm[k] == pytest.approx(r) and peak[k] == pytest.approx(p, abs=0.01) and ang[k] == pytest.approx(a, abs=0.02) and snr[k] > 5
    assert (n == 200).all()


def test_masked_samples_and_empty_pixels():
    freq, q, u = generators.two_sources()
    q, u = generators.with_bad_channels(q, u)
    ax = Axes.of(freq, rm_axis(-50.0, 50.0, 101))
    q, u = (c.reshape(200, -1).T for c in (q, u))
    w = (~np.isnan(q)).astype(float)
    re, _, n = synthesis.transform(q, u, w, ax)
    assert n[10 * 32 + 12] == 199 and n[25 * 32 + 25] == 0
    assert np.isnan(re[25 * 32 + 25]).all() and np.isfinite(np.delete(re, 25 * 32 + 25, 0)).all()


def test_mean_removal_is_blind_to_offsets(sources):
    ax, q, u = sources
    a = synthesis.transform(q[:50], u[:50], np.ones((50, 200)), ax, True)[0]
    b = synthesis.transform(q[:50] + 3, u[:50] - 2, np.ones((50, 200)), ax, True)[0]
    assert np.allclose(a, b, atol=1e-9)


def test_relational_equals_arrow(spark, sources):
    ax, q, u = sources
    few = Axes(ax.lsq[:20], ax.rm[::20], np.arange(20) % 7 > 0)
    rows = [(k % 3, k // 3, c, float(q[k, c]), float(u[k, c])) for k in range(9) for c in range(20)]
    df = mask.weighted(spark.createDataFrame(rows, "x int, y int, chan int, q double, u double"), few.channels(spark))
    one = {(r["x"], r["y"], r["irm"]): (r["re"], r["im"]) for r in synthesis.relational(df, few.channels(spark), few.depths(spark)).collect()}
    arrays = synthesis.synthesise(synthesis.spectra(df, 20), few, "ri", precision="double")
    two = {(r["x"], r["y"], r["irm"]): (r["re"], r["im"]) for r in synthesis.exploded(arrays, few.depths(spark)).collect()}
    assert one.keys() == two.keys()
    assert all(np.allclose(one[k], two[k], atol=1e-12) for k in one)
    plan = arrays._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan


def test_unknown_modes_are_errors(spark, sources):
    with pytest.raises(ValueError):
        synthesis.synthesise(None, sources[0], "xx")


@settings(max_examples=60, deadline=None)
@given(st.floats(-100, -1), st.floats(1, 100), st.integers(3, 400))
def test_depths_over_zero_have_an_exact_zero(beg, end, n):
    rm = rm_axis(beg, end, n)
    assert len(rm) == n and (rm == 0).sum() == 1
    assert rm[0] >= beg - 1e-9 and rm[-1] <= end + 1e-9
    assert np.allclose(np.diff(rm), rm[1] - rm[0])


def test_axes():
    assert axes.linspace(1, 5, 1).tolist() == [5.0] and len(axes.linspace(0, 1, 0)) == 100 and axes.linspace(0, 4, 5).tolist() == [0, 1, 2, 3, 4]
    assert rm_axis(3, 9, 1).tolist() == [3.0] and rm_axis(1, 4, 4).tolist() == [1, 2, 3, 4]
    assert axes.channel_frequencies(550e6, 0.9, 1e6, 3).tolist() == [550, 551, 552]
    with pytest.raises(ValueError):
        axes.frequency_unit(5.0)
    lo, hi = axes.auto_rm_range(550.0 + np.arange(200))
    assert lo == -hi < 0
    a, b = axes.auto_rm_range(550.0 + np.arange(200), compat=True)
    assert a == pytest.approx(-lo) and b == pytest.approx(lo)
    step, span = axes.rm_resolution(600e6, 1e6, 10)
    assert span == pytest.approx(10 * step)


def test_channel_frequencies_of_rows_are_those_of_numpy(spark):
    nan, far = float("nan"), [30.0, 1e4, 30e6, 10e9, 701.3, 701.3e6]
    rows = [(i, v, p, 1.7 if v < 1e6 else 1.7e6, n) for i, (v, p, n) in enumerate((v, p, n) for v in far for p in (0.9, 2.7, 5.0) for n in (1, 7))]
    df = spark.createDataFrame(rows, "id int, crval double, crpix double, cdelt double, n int")
    got = {r["id"]: r["mhz"] for r in df.select("id", C.channel_frequencies("crval", "crpix", "cdelt", "n").alias("mhz")).collect()}
    assert got == {i: axes.channel_frequencies(v, p, d, n).tolist() for i, v, p, d, n in rows}
    odd = [(nan, 1.0, 1.0, 3), (None, 1.0, 1.0, 3), (29.0, 1.0, 1.0, 3), (2e4, 1.0, 1.0, 3), (2e10, 1.0, 1.0, 3), (700.0, 1.0, 1.0, None)]
    odd = spark.createDataFrame([*odd, *odd], "crval double, crpix double, cdelt double, n int").withColumn("mhz", C.channel_frequencies("crval", "crpix", "cdelt", "n"))
    assert [r["mhz"] for r in odd.collect()] == [None] * 12 and odd.select(F.explode("mhz")).count() == 0
    part = spark.createDataFrame([(700.0, None, None, 2), (700.0, 1.0, None, 2), (700.0, None, 1.0, 2)], "crval double, crpix double, cdelt double, n int")
    assert [r[0] for r in part.select(C.channel_frequencies("crval", "crpix", "cdelt", "n")).collect()] == [[None, None], [None, None], [700.0, 701.0]]
    whole = spark.createDataFrame([(700, 1, 2, 2)], "crval int, crpix int, cdelt int, n int").select(C.channel_frequencies("crval", "crpix", "cdelt", "n").alias("mhz"))
    assert whole.dtypes == [("mhz", "array<double>")] and whole.first()["mhz"] == [700.0, 702.0]


def test_the_unit_of_an_axis_is_not_told_channel_by_channel(spark, tables):
    from faradeon.queries import QUERIES

    for name in ("p3_channel_axis", "p15_rm_resolution"):
        plan = QUERIES[name](spark, tables)._jdf.queryExecution().analyzed().toString()
        each = [x.split(", lambda x")[0] for x in plan.split("lambdafunction(")[1:]]
        assert each and not any("CASE" in x for x in each)


def test_tail_snr_uses_order_statistics():
    amp = np.array([[3.0, 1.0, 2.0, 10.0, 4.0, np.nan], [1.0, 1.0, 1.0, 5.0, 1.0, 1.0], [np.nan] * 6])
    peak, rm, _, snr = cubestat.peak_of(amp, np.zeros_like(amp), np.arange(6.0))
    assert snr[0] == pytest.approx(10 / ((3 - 1) / 0.67449)) and rm[0] == 3
    assert snr[1] == pytest.approx(5 / 1e-12)
    assert np.isnan(peak[2]) and np.isnan(snr[2])


def test_argmax_ties_and_nan(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 5.0), (2, 5.0), (3, float("nan")), (4, None)], "k int, v double")
    r = df.agg(cubestat.first_argmax("k", "v", "k").alias("a"), cubestat.last_argmax("k", "v", "k").alias("b")).first()
    assert (r["a"], r["b"]) == (1, 2)


def test_mask_rules(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 0, c, q, 1.0) for c, q in enumerate((1.0, nan, -999.0, None, inf, 2.0))]
    df = spark.createDataFrame(rows, "x int, y int, chan int, q double, u double")
    m = spark.createDataFrame([(0, 0, c, v) for c, v in enumerate((1.0, 1.0, 1.0, 1.0, 1.0, 0.5))], "x int, y int, chan int, m double")
    w = lambda **k: [r["w"] for r in mask.weighted(df, **k).orderBy("chan").collect()]
    assert w() == [1, 0, 0, 0, 1, 1]
    assert w(infinite=True)[4] == 0
    assert w(mask=m)[5] == 0
    assert w(nan_check=False)[1] == 1
    with pytest.raises(ValueError):
        mask.check_range("x", 5, 3, 1, 10)
    with pytest.raises(ValueError):
        mask.compatible({"naxes": [1]}, {"naxes": [2]})


def test_clean_finds_a_source_between_sidelobes(spark):
    ax = Axes.of(700 + 4 * np.arange(64), rm_axis(-200.0, 200.0, 201))
    q, u = np.cos(2 * (0.3 + 50 * ax.lsq)), np.sin(2 * (0.3 + 50 * ax.lsq))
    re, im, _ = synthesis.transform(q[None], u[None], np.ones((1, 64)), ax)
    dirty = re[0] + 1j * im[0]
    assert np.allclose(dirty, clean.dirty_beam(ax, 50.0, 0.3))
    found = clean.clean(dirty, ax, threshold=1.0, niter=500)
    at = np.abs(found.components).argmax()
    assert ax.rm[at] == pytest.approx(50.0, abs=4) and abs(found.components.sum()) == pytest.approx(1, abs=0.1)
    assert np.abs(found.residual).max() < 0.15
    restored = clean.restore(found.components, 6.0)
    assert np.abs(restored).argmax() == pytest.approx(at, abs=1)
    edge = clean.clean(clean.dirty_beam(ax, ax.rm[0]), ax, niter=50)
    assert np.isfinite(edge.components).all()
    df = spark.createDataFrame([(0, 0, q.tolist(), u.tolist(), [1] * 64)], "x int, y int, q array<double>, u array<double>, w array<int>")
    assert clean.clean_spectra(df, ax, niter=50).first()["iterations"] > 0


@pytest.mark.parametrize("method", [1, 2, 3, 4, 9])
def test_peaks_between_depths(method):
    x = np.arange(64)
    spectrum = np.exp(-0.5 * ((x - 30.3) / 3) ** 2) * np.exp(0.2j * (x - 30.3))
    place, value = clean.interpolated_peak(spectrum, method)
    assert place == pytest.approx(30.3, abs=0.07) and value == pytest.approx(1, abs=0.01)


def test_single_stokes_and_depolarisation():
    ax = Axes.of(700 + 4 * np.arange(64), rm_axis(-200.0, 200.0, 101))
    both = clean.dirty_beam(ax, 40.0, 0.1, stokes="Q") + clean.dirty_beam(ax, 40.0, 0.1, stokes="U")
    assert np.allclose(both, clean.dirty_beam(ax, 40.0, 0.1))
    loss = clean.depolarisation_weight(np.array([0.0, 100.0, 2000.0]), 700 + 4 * np.arange(64), 4.0)
    assert loss[0] == pytest.approx(1) and abs(loss[2]) < abs(loss[1]) < 1
    assert clean.beam_width(clean.dirty_beam(ax)) > 1
    assert clean.phase_of_components(np.cos(2 * 7 * ax.lsq - 0.4), ax.lsq, 7) == pytest.approx(0.4, abs=0.3)


def test_fits(spark):
    x = np.arange(200.0)
    y = 1 + 0.01 * x + np.cos(2 * np.pi * x / 199)
    assert np.allclose(fitting.poly_harm_fit(x, y), y, atol=1e-8)
    rows = [(1, int(k), float(v + 9 * (k == 77))) for k, v in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "g int, k int, v double")
    assert [r["k"] for r in fitting.outliers(df, ["g"], "k", "v", 5.0).collect()] == [77]
    assert np.allclose(fitting.moving_fit(x, y, 50), y, atol=1e-2)
    assert fitting.moving_median(np.array([1.0, 9, 2, 8, 3, 7, 4]), 4, 2).tolist() == [8, 8, 7.5, 7.5, 7, 7, 4]
    t = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    ex, ey = 3 + 5 * np.cos(t) * np.cos(0.4) - 2 * np.sin(t) * np.sin(0.4), -1 + 5 * np.cos(t) * np.sin(0.4) + 2 * np.sin(t) * np.cos(0.4)
    cx, cy, a, b, _ = fitting.fit_ellipse(ex, ey)
    assert np.allclose([cx, cy, a, b], [3, -1, 5, 2], atol=1e-6)


def test_robust_moments(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(5, 1, 2000), [500.0] * 5])
    mean, rms, n = statistics.robust_meanrms(v)
    assert mean == pytest.approx(5, abs=0.1) and rms == pytest.approx(1, abs=0.1) and n <= 2000
    df = spark.createDataFrame([("a", float(x)) for x in v], "g string, v double")
    r = statistics.robust_moments(df, "v", ["g"]).first()
    assert (r["mean"], r["rms"], r["n"]) == (pytest.approx(mean), pytest.approx(rms), n)


def test_order_statistics_close_in_on_ranks(spark):
    rng = np.random.default_rng(4)
    for v in (np.concatenate([rng.normal(size=3000), [7.0] * 900, [1e300, -1e300]]), np.repeat([1.0, 2.0], 1000), np.array([3.0])):
        df, s = spark.createDataFrame([(float(x),) for x in v], "v double").cache(), np.sort(v)
        for k in {0, len(v) // 3, len(v) // 2, 3 * len(v) // 4, len(v) - 1}:
            assert statistics.order_statistic(df, "v", k, len(v), 50, 20) == s[k]
        assert statistics.percentile(df, "v", 0.13) == pytest.approx(np.percentile(v, 13))
        df.unpersist()
    assert statistics.percentile(df.where("false"), "v", 0.5) is None
    assert statistics.trimmed_histogram(df.where("false"), "v", 3, 10.0).agg(F.sum("n")).first()[0] == 0


def test_fourier(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(8, 8))
    assert np.allclose(fourier.fft(fourier.fft(a), inverse=True), a)
    assert fourier.power_spectrum(a).sum() == pytest.approx(a.var())
    assert fourier.autocorrelation(a)[4, 4] == pytest.approx(a.var() * 64 / 64)
    assert np.allclose(fourier.align(a, 2, 1), fourier.align(a, 2, 1, whole=False))
    assert fourier.offset_between(np.roll(a, (1, 2), (0, 1)), a) == (2, 1)
    assert np.allclose(fourier.swap_phase(a, a), a)
    assert fourier.convolve(np.array([1.0, 2]), np.array([1.0, 1])).tolist() == [1, 3, 2]


def test_spectra_of_planes_by_lines(spark):
    rng = np.random.default_rng(6)
    cube = [(k, x, y, float(rng.normal())) for k, nx, ny in ((None, 4, 5), (0, 7, 6), (3, 1, 8)) for x in range(3, 3 + nx) for y in range(-2, ny - 2) if (x, y) != (4, 0) and not (k == 0 and x == 5)]
    df = spark.createDataFrame([*cube, (9, 0, 0, None), (9, 1, 0, float("nan"))], "irm int, x int, y int, val double")
    for lines, kernel in ((fourier.power_spectra, fourier.power_spectrum), (fourier.autocorrelations, fourier.autocorrelation)):
        a, b = ({(r["irm"], r["x"], r["y"]): r["val"] for r in rows.collect()} for rows in (lines(df), fourier.per_plane(df, "irm", kernel)))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)
    assert fourier.power_spectra(df.where("false")).count() == 0


def test_image_operators(spark):
    img = spark.createDataFrame([(x, y, float(x + 10 * y)) for x in range(1, 6) for y in range(1, 6)], "x int, y int, val double")
    with pytest.raises(ValueError):
        images.aligned(img, img.where("x > 1"), check=True)
    assert images.cut_out(img, 3, 3, 3, 3, even=True).count() == 16
    assert images.summary(images.combine(images.aligned(img, img), "DIFF")).first()["rms"] == 0


def test_matrices(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]], [[0.0, 1.0], [1.0, 0.0]])], "id long, a array<array<double>>, b array<array<double>>")
    assert statistics.matrix_products(df).first()["product"] == [[2.0, 1.0], [4.0, 3.0]]
    assert np.allclose(statistics.inverse([[2, 0], [0, 4]]), [[0.5, 0], [0, 0.25]])


def test_coordinates(spark):
    df = spark.range(1)
    ha, dec, lat = F.lit(0.4), F.lit(0.2), F.lit(0.5)
    az, za = C.azimuth_zenith(ha, dec, lat)
    ra, back = C.equatorial(az, za, lat, F.lit(2.0))
    pra, pdec = C.precessed(F.lit(np.radians(41.054063)), F.lit(np.radians(49.227750)), 2000.0, 2028.8670500)
    r = df.select(ra.alias("ra"), back.alias("dec"), C.sidereal_time(az, za, lat, F.lit(1.6)).alias("lst"), C.greenwich_sidereal_degrees(F.lit(2446895.5)).alias("g"), F.degrees(pra).alias("pra"), F.degrees(pdec).alias("pdec")).first()
    assert r["ra"] == pytest.approx(1.6) and r["dec"] == pytest.approx(0.2) and r["lst"] == pytest.approx(2.0)
    assert r["g"] == pytest.approx(197.693195, abs=1e-4)
    assert r["pra"] == pytest.approx(41.547214, abs=2e-4) and r["pdec"] == pytest.approx(49.348483, abs=2e-4)


def test_run_log(spark):
    events = runlog.parse(spark.createDataFrame([(x,) for x in [*generators.run_log(), "noise"]], "value string"))
    runs = runlog.split_runs(events)
    assert [r["n"] for r in runs.groupBy("run").agg(F.count("*").alias("n")).orderBy("run").collect()] == [57, 56]
    assert runlog.select_run(runs, "latest").select("run").distinct().first()["run"] == 1
    assert runlog.select_run(runs, "0").count() == 57 and runlog.select_run(runs, -2).count() == 57
    spans = runlog.intervals(runs)
    assert spans.where("run = 1 and stage = 'tile_write'").count() == 6
    totals = {r["stage"]: r["seconds"] for r in runlog.stage_totals(spans.where("run = 0")).collect()}
    assert totals == {"tile_read": 10.5, "tile_mask": 1.75, "tile_compute": 14.0, "tile_write": 17.5}
    cross = runlog.cross_overlap(spans.where("run = 0"), "stage", "tile_read", "tile_write").first()["seconds"]
    assert cross == pytest.approx(6 * 1.5)
    gaps = runlog.split_runs(events.where("event <> 'run_start'"))
    assert gaps.select("run").distinct().count() == 2
    for log in (events, events.where("event <> 'run_start'"), events.where("level is null")):
        ranged, whole = (sorted(map(str, runlog.split_runs(log, 300.0, by, n).collect())) for by, n in (((), 7), ((), 10**9)))
        assert ranged == whole
    kinds = {r["value"]: r["event"] for r in runlog.parse(spark.createDataFrame([("2026-01-01T00:00:00.000 [debug] [tile_async] [tid=3] async enqueue compute slot=1 sub=2",), ("2026-01-01T00:00:00.000 [debug] [tile_compute] [tid=3] gpu send",)], "value string")).selectExpr("stage value", "event").collect()}
    assert kinds == {"tile_async": "enqueue", "tile_compute": "gpu_send"}


def test_time_ranges_do_not_change_sweeps_and_ranks(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(300):
        t = int(rng.integers(0, 5000))
        for event, at in (("start", t), ("done", t + int(rng.integers(1, 400)))):
            rows.append((None if k % 3 == 0 else k % 3, "ab"[k % 2], event, at, int(rng.integers(0, 9))))
    events = spark.createDataFrame(rows, "run int, stage string, event string, s long, bytes long").select("run", "stage", "event", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "bytes")
    whole = 10**9

    def both(f):
        a, b = ([tuple(r) for r in f(n).collect()] for n in (60, whole))
        assert sorted(map(str, a)) == sorted(map(str, b)) and a

    both(lambda n: runlog.intervals(events, range_seconds=n))
    spans = runlog.intervals(events)
    both(lambda n: runlog.active_counts(spans, range_seconds=n))
    both(lambda n: runlog.self_overlap(spans, range_seconds=n).select("run", F.round("seconds", 6)))
    both(lambda n: runlog.cross_overlap(spans, "stage", "a", "b", range_seconds=n).select("run", F.round("seconds", 6)))


def test_levels_of_a_time_range_do_not_meet_by_group(spark):
    """Thousands of levels in each of a few ranges: seconds of brute force, and no frame that is added up anew for every row."""
    rng = np.random.default_rng(11)
    t0 = rng.integers(0, 9_000_000_000, 6000)
    t1 = t0 + rng.integers(1, 5_000_000_000, 6000)
    kinds = rng.integers(0, 2, 6000)
    rows = spark.createDataFrame([(None, "ab"[k], int(a), int(b)) for k, a, b in zip(kinds, t0, t1)], "run int, stage string, a long, b long")
    spans = rows.select("run", "stage", F.timestamp_micros("a").alias("t0"), F.timestamp_micros("b").alias("t1"))
    t, kind, d = np.concatenate([t0, t1]), np.tile(kinds, 2), np.repeat([1, -1], 6000)
    order = np.argsort(t, kind="stable")
    t, a, b = t[order], np.cumsum((d * (kind == 0))[order]), np.cumsum((d * (kind == 1))[order])
    gaps = np.diff(t)
    for found, open_ in ((runlog.cross_overlap(spans, "stage", "a", "b"), (a > 0) & (b > 0)), (runlog.self_overlap(spans), a + b >= 2)):
        assert found.first()["seconds"] == pytest.approx(int(gaps[open_[:-1]].sum()) / 1e6, abs=1e-6) and found.count() == 1
        assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower().replace(" ", "")


def test_clean_of_one_stokes_and_depolarisation(spark):
    ax = Axes.of(300 + 4 * np.arange(64), rm_axis(-100.0, 100.0, 201))
    angle = 2 * (0.2 + 40 * ax.lsq)
    df = spark.createDataFrame([(1, 1, np.cos(angle).tolist(), np.sin(angle).tolist(), [1] * 64)], "x int, y int, q array<double>, u array<double>, w array<int>")
    one = clean.clean_spectra(df, ax, stokes="Q", niter=200).first()
    at = ax.rm[np.abs(np.array(one["re"]) + 1j * np.array(one["im"])).argmax()]
    assert abs(abs(at) - 40) <= 8 and one["iterations"] > 0  # a real signal has both signs of depth
    loss = clean.depolarisation_weight(ax.rm, 300 + 4 * np.arange(64), 4.0)
    flat = spark.createDataFrame([(1, 1, loss.real.tolist(), loss.imag.tolist())], "x int, y int, re array<double>, im array<double>")
    r = clean.depolarisation_corrected(flat, ax, 4.0).first()
    assert np.allclose(r["re"], 1) and np.allclose(r["im"], 0)


def test_fk4_precession():
    """B1950 to B2000, against the rotation of the equinox by general precession: about 50.26 arc seconds a year."""
    zeta, z, theta = C.precession_angles(1950.0, 2000.0, "FK4")
    assert np.degrees(zeta + z) * 3600 / 50 == pytest.approx(46.1, abs=0.05) and np.degrees(theta) * 3600 / 50 == pytest.approx(20.04, abs=0.02)


def test_macro_timing_and_speed_up(spark):
    t = spark.createDataFrame([("total", 10.0), ("a", 4.0), ("b", 3.0)], "stage string, seconds double")
    assert {r["stage"]: r["percent"] for r in runlog.macro_timing(t).collect()} == {"total": 100, "a": 40, "b": 30, "other": 30}
    s = spark.createDataFrame([(1, 8.0), (4, 2.0)], "threads int, elapsed double")
    assert sorted(r["speedup"] for r in runlog.speed_up(s).collect()) == [1, 4]


def test_streams_equal_batches(spark, tmp_path):
    from faradeon import streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(generators.run_log()))
    events = streaming.log_stream(spark, str(tmp_path / "in"))
    q = streaming.stage_windows(events).writeStream.format("memory").queryName("stages").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("stages").agg(F.sum("events")).first()[0] >= 113
    ax = Axes.of(700 + 4 * np.arange(8), rm_axis(-10.0, 10.0, 5))
    rng = np.random.default_rng(3)
    rows = [(x, 0, c, float(rng.normal()), float(rng.normal()), int(c != 3)) for x in range(3) for c in range(8)]
    df = spark.createDataFrame(rows, "x int, y int, chan int, q double, u double, w int")
    df.write.parquet(str(tmp_path / "cube"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "cube"))
    q = streaming.partial_sums(stream, ax.channels(spark), ax.depths(spark)).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    live = {(r["x"], r["irm"]): r["re"] for r in streaming.finished(spark.table("live"), remove_mean=True).collect()}
    whole = {(r["x"], r["irm"]): r["re"] for r in synthesis.relational(mask_mean(df), ax.channels(spark), ax.depths(spark)).collect()}
    assert live.keys() == whole.keys() and all(live[k] == pytest.approx(whole[k]) for k in live)


def mask_mean(df):
    return synthesis.mean_removed(df)
