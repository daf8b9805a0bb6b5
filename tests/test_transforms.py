"""Transforms, scans, merged least squares, random columns and matrices against NumPy and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faradeon.functions import columns as C
from faradeon.operators import fitting, fourier, least_squares, matrices, scan, transforms


def lines(spark, values, parts=5):
    rows = [(g, k, float(v.real), float(v.imag)) for g, line in enumerate(values) for k, v in enumerate(line) if v != 0]
    return spark.createDataFrame(rows, "g int, k int, re double, im double").repartition(parts)


@pytest.mark.parametrize("n, line", [(1, 8), (12, 4), (12, 64), (60, 10), (35, 8), (7, 7)])
def test_fourier_lines(spark, n, line):
    rng = np.random.default_rng(n)
    values = rng.normal(size=(3, n)) + 1j * rng.normal(size=(3, n))
    values[1, : n // 2] = 0  # points that a line lacks
    for inverse, want in ((False, np.fft.fft(values)), (True, np.fft.ifft(values))):
        got = np.zeros((3, n), complex)
        for r in transforms.fourier(lines(spark, values), ["g"], "k", n, inverse=inverse, line=line).collect():
            got[r["g"], r["k"]] = r["re"] + 1j * r["im"]
        assert np.allclose(got, want)


def test_lines_that_cannot_be_split(spark):
    assert transforms.factors(60, 10) == (10, 6)
    with pytest.raises(ValueError, match="pad"):
        transforms.fourier(spark.range(3).selectExpr("0 g", "int(id) k", "1.0 re", "0.0 im"), ["g"], "k", 13, line=4)
    twice = spark.createDataFrame([(0, 1, 1.0, 0.0)] * 2, "g int, k int, re double, im double")
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        transforms.fourier(twice, ["g"], "k", 4).collect()


def test_alignment(spark):
    rng = np.random.default_rng(1)
    a = np.stack([rng.normal(size=(6, 10)) for _ in range(3)])
    turns = [(0, 0), (3, -2), (-4, 1)]
    b = np.stack([np.roll(p, (-dy, -dx), (0, 1)) for p, (dx, dy) in zip(a, turns)])
    table = lambda m: spark.createDataFrame([(g, x, y, float(m[g, y, x])) for g in range(3) for y in range(6) for x in range(10)], "g int, x int, y int, val double")
    found = {r["g"]: (r["dx"], r["dy"]) for r in transforms.offsets(table(a), table(b), ["g"], 10, 6, line=5).collect()}
    assert found == dict(enumerate(turns)) == {g: fourier.offset_between(a[g], b[g]) for g in range(3)}
    odd = rng.normal(size=(1, 5, 7))
    one = spark.createDataFrame([(0, x, y, float(odd[0, y, x])) for y in range(5) for x in range(7)], "g int, x int, y int, val double")
    shifts = spark.createDataFrame([(0, 1.5, -0.25)], "g int, dx double, dy double")
    got = np.zeros((5, 7))
    for r in transforms.moved(one, shifts, ["g"], 7, 5).collect():
        got[r["y"], r["x"]] = r["val"]
    assert np.allclose(got, fourier.align(odd[0], 1.5, -0.25, whole=False))


@pytest.mark.parametrize("block", [3, 7, 1000])
@pytest.mark.parametrize("mirror", [False, True])
def test_convolution_across_ranges(spark, block, mirror):
    rng = np.random.default_rng(block)
    t = [1.0, -2.0, 0.5]
    series = {g: rng.normal(size=n) for g, n in ((0, 50), (1, 1), (None, 9))}
    rows = [(g, k - 4, float(v)) for g, s in series.items() for k, v in enumerate(s)]
    df = spark.createDataFrame(rows, "g int, k long, v double").repartition(6)
    got = {}
    for r in transforms.convolved(df, ["g"], "k", "v", t, mirror, block).collect():
        got.setdefault(r["g"], {})[r["k"]] = r["v"]
    for g, s in series.items():
        want = np.convolve(s, t[::-1] if mirror else t)
        assert sorted(got[g]) == list(range(-4, -4 + len(want))) and np.allclose([got[g][k] for k in sorted(got[g])], want)
    gap = spark.createDataFrame([(0, 0, 1.0), (0, 100, None)], "g int, k long, v double")
    assert {r["k"]: r["v"] for r in transforms.convolved(gap, ["g"], "k", "v", t, block=7).collect()} == {0: 1.0, 1: -2.0, 2: 0.5, 100: 0.0, 101: 0.0, 102: 0.0}


@pytest.mark.parametrize("parts", [1, 9])
def test_bias_correction_with_state_equals_a_loop(spark, parts):
    rng = np.random.default_rng(6)
    rows = [(x, y, c, float(rng.normal()) if (x + c) % 11 else float("nan"), float(rng.normal()), float(rng.uniform(1, 3))) for y in range(7) for x in range(4) for c in range(5)]
    df = spark.createDataFrame(rows, "x int, y int, chan int, q double, u double, i double").repartition(parts)
    got = {(r["x"], r["y"], r["chan"]): (r["q"], r["u"]) for r in scan.bias_corrected(df, {"q": (0.1, 0.2), "u": (-0.3, 0.0)}).collect()}
    slopes = [0.1, -0.3]
    for x, y, c, q, u, i in sorted(rows, key=lambda r: (r[1], r[0], -r[2])):
        for k, (v, resi) in enumerate(((q, 0.2), (u, 0.0))):
            slopes[k] = slopes[k] if v >= resi else -slopes[k]
            want = v - (i * slopes[k] + resi)
            assert got[x, y, c][k] == pytest.approx(want, nan_ok=True)


def test_least_squares_merge(spark):
    rng = np.random.default_rng(4)
    pts = [(g, float(a), float(b), float(2 * a - b + g + rng.normal() * 0.01)) for g in range(4) for a, b in rng.normal(size=(50, 2))] + [(9, 1.0, 2.0, 3.0), (9, None, 2.0, 3.0), (8, 1.0, 1.0, float("nan"))]
    df = spark.createDataFrame(pts, "g int, a double, b double, v double")
    basis = [F.lit(1.0), F.col("a"), F.col("b")]
    found = {parts: {r["g"]: r["coefficients"] for r in least_squares.least_squares(df.repartition(parts), ["g"], basis, F.col("v")).collect()} for parts in (1, 13)}
    assert sorted(found[1]) == [0, 1, 2, 3, 9]
    for g in range(4):
        m = np.array([(1, a, b) for k, a, b, _ in pts if k == g], float)
        want = np.linalg.lstsq(m, np.array([v for k, _, _, v in pts if k == g]), rcond=None)[0]
        assert np.allclose(found[1][g], want) and np.allclose(found[13][g], want)
    assert np.allclose(found[1][9], [1, 1, 0.5])  # the least of many: each column gives the same share


def test_series_fit_equals_that_of_arrays(spark):
    rng = np.random.default_rng(7)
    y = np.sin(np.arange(80) / 9) + rng.normal(size=80) * 0.1
    y[7] = np.nan
    df = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(y)], "g int, k int, v double")
    got = {r["k"]: r["fit"] for r in least_squares.series_fit(df, ["g"], "k", "v").collect()}
    assert np.allclose([got[k] for k in range(80)], fitting.poly_harm_fit(np.arange(80), y), atol=1e-8)


def test_ellipses(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for g in range(5):
        t = rng.uniform(0, 2 * np.pi, 40 + g)
        px, py = (4 + g) * np.cos(t) + rng.normal(size=len(t)) * 0.02, 2 * np.sin(t) + rng.normal(size=len(t)) * 0.02
        x, y = 1e4 + px * np.cos(g) - py * np.sin(g), px * np.sin(g) + py * np.cos(g) - 50
        want[g] = fitting.fit_ellipse(x, y)
        rows += [(g, float(a), float(b)) for a, b in zip(x, y)]
    rows += [(7, 1.0, 1.0)] * 9 + [(8, float(k), float(k)) for k in range(9)] + [(9, 1.0, None)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    got = {r["g"]: r for r in least_squares.ellipses(df.repartition(11), ["g"]).collect()}
    for g, (x0, y0, major, minor, angle) in want.items():
        r = got[g]
        assert np.allclose([r["x0"], r["y0"], r["major"], r["minor"]], [x0, y0, major, minor], rtol=1e-6)
        assert np.isclose(np.sin(r["angle"] - angle), 0, atol=1e-5) and r["n"] == 40 + g
    assert sorted(got) == [0, 1, 2, 3, 4, 7, 8] and got[7]["x0"] is None


def test_random_numbers_belong_to_rows(spark):
    df = spark.range(3000).selectExpr("id", "nullif(id % 3, 0) k")
    draw = lambda n: sorted(map(tuple, df.repartition(n).select("id", C.uniform(5, "id", "k"), C.normal(5, "id", "k"), C.noisy("id", 2.0, 5, "id", "k")).collect()))
    a = draw(1)
    assert a == draw(200)
    u, n = np.array([r[1] for r in a]), np.array([r[2] for r in a])
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.03 and abs(n.mean()) < 0.08 and abs(n.std() - 1) < 0.05
    assert all(r[3] == r[0] + 2 * r[2] for r in a)
    assert len({r[1] for r in a}) == 3000 and a != sorted(map(tuple, df.select("id", C.uniform(6, "id", "k"), C.normal(6, "id", "k"), C.noisy("id", 2.0, 6, "id", "k")).collect()))
    with pytest.raises(ValueError):
        C.noisy("id", 1.0, 1)


def test_matrices(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 7, 5)), rng.normal(size=(2, 5, 9))
    table = lambda m: spark.createDataFrame([(g, i, j, float(m[g, i, j])) for g in range(len(m)) for i in range(m.shape[1]) for j in range(m.shape[2])], "g int, i int, j int, v double")
    for block in (2, 64):
        out = np.zeros((2, 7, 9))
        for r in matrices.product(table(a), table(b), ["g"], block).collect():
            out[r["g"], r["i"], r["j"]] = r["v"]
        assert np.allclose(out, a @ b)
    square = np.stack([rng.normal(size=(4, 4)), np.ones((4, 4))])
    rows = matrices.inverse(table(square), 4, ["g"]).collect()
    assert {r["g"] for r in rows} == {0}  # the other is singular
    out = np.zeros((4, 4))
    for r in rows:
        out[r["i"], r["j"]] = r["v"]
    assert np.allclose(out @ square[0], np.eye(4))
    assert {(r["i"], r["j"]) for r in matrices.transposed(table(a)).collect()} == {(j, i) for i in range(7) for j in range(5)}
