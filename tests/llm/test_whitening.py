"""Embedding whitening against brute force, and on odd and empty tables."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faradeon.llm import whitening
from faradeon.llm.queries import op13_whitening

SCHEMA = "vec_id long, embedding array<double>, x string, p int, n string, q string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "a", 1, "b", "c") for i, v in rows], SCHEMA)


def brute(rows, components=16):
    """{vec_id: (n, deviation, [whitened, absolute], explained)} by numpy's own solver and Python integers."""
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(len(v) for _, v in kept)
    ints = [(i, tuple(math.floor(64 * x) + 1_000_000 for x in [*v, *[0.0] * (width - len(v))])) for i, v in kept]
    fit = sorted({x for _, x in ints})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = lambda x: [n * a - s for a, s in zip(x, sums)]
    m = np.array([[c / n for c in centred(x)] for x in fit])
    values, vectors = np.linalg.eigh(m.T @ m / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, width)
    return n, [(i, sum(c * c for c in centred(x)), np.abs(np.array(centred(x)) / n @ vectors[:, :k] / np.sqrt(np.maximum(values[:k], 1e-300)))) for i, x in ints], values[:k] / values.sum()


def compare(df, rows):
    n, want, explained = brute(rows)
    got = df.collect()
    k = len(explained)
    assert len(got) == k * len(want)
    assert {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, k + 1))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    assert all(r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9) for r in got)
    key = lambda i: (i is not None, i or 0)
    assert sorted(((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1), key=lambda x: (key(x[0]), x[1])) == sorted(((i, d) for i, d, _ in want), key=lambda x: (key(x[0]), x[1]))
    for c in range(k):
        a = sorted((*key(r["vec_id"]), round(abs(r["whitened"]), 6)) for r in got if r["component"] == c + 1)
        b = sorted((*key(i), round(float(w[c]), 6)) for i, _, w in want)
        assert all(x[:2] == y[:2] and x[2] == pytest.approx(y[2], rel=1e-6, abs=2e-6) for x, y in zip(a, b, strict=True))


def test_whitening_of_the_embeddings(spark, tables):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()]
    compare(op13_whitening(spark, tables), rows)


@pytest.mark.parametrize("parts", [1, 37])
def test_whitening_odd_rows(spark, parts):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=5) * [9, 5, 3, 2, 1] + 40).tolist()) for k in range(200)]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, rows[4][1]), (None, rows[4][1][:3])] + [(900 + k, rows[0][1]) for k in range(300)]
    odd = [(500, None), (501, [1.0, None, 2.0, 3.0, 4.0]), (502, [1.0, float("nan"), 2.0, 3.0, 4.0]), (503, [float("inf")] * 5)]
    compare(whitening.whiten(table(spark, rows + odd).repartition(parts)), rows)


def test_components_without_variance(spark):
    rows = [(k, [float(k), 2.0 * k, 5.0]) for k in range(20)]
    got = whitening.whiten(table(spark, rows)).collect()
    assert len(got) == 60 and all((r["whitened"] is None) == (r["component"] > 1) for r in got)
    assert got[0]["identity_error"] < 1e-9 and sum(r["explained"] for r in got[:3]) == pytest.approx(1)
    same = whitening.whiten(table(spark, [(1, [1.0, 2.0])] * 3)).collect()
    assert len(same) == 6 and all(r["whitened"] is None and r["n"] == 1 and r["deviation"] == 0 and r["identity_error"] == 0 for r in same)


def test_whitening_of_nothing(spark):
    for rows in ([], [(1, None), (2, [float("nan")])], [(1, []), (2, [])]):
        df = whitening.whiten(table(spark, rows))
        assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and df.count() == 0


def test_large_entries_are_exact(spark):
    rows = [(1, [1e300, 3.0]), (2, [-1e300, 4.0]), (3, [2.0**50, 5.0])]
    got = {r["vec_id"]: r for r in whitening.whiten(table(spark, rows)).collect() if r["component"] == 1}
    assert all(r["deviation"] == (1 << 63) - 1 for r in got.values())
    rows = [(k, [2.0**20 * k, float(k % 3)]) for k in range(4)]
    compare(whitening.whiten(table(spark, rows)), rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 24), st.integers(0, 1 << 30), st.integers(0, 3))
def test_symmetric_qr(n, seed, kind):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, n)) * 10.0 ** rng.integers(-8, 9)
    a = {0: a @ a.T, 1: a + a.T, 2: np.diag(np.repeat(rng.normal(size=1), n)), 3: np.outer(a[0], a[0])}[kind]
    values, vectors = whitening.symmetric_qr(a)
    size = np.abs(a).max() + 1e-300
    assert np.all(np.diff(values) <= 1e-9 * size)
    assert np.allclose(vectors @ vectors.T, np.eye(n), atol=1e-12)
    assert np.allclose(vectors @ a @ vectors.T, np.diag(values), atol=1e-12 * size * n)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * size * n)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-(1 << 20), 1 << 20), min_size=3, max_size=3), min_size=1, max_size=40), st.integers(1, 5))
def test_merged_moments_equal_those_of_the_whole(rows, parts):
    m = np.array(rows, np.int64) + 1_000_000
    total = whitening.Moments.empty(3)
    for part in np.array_split(m, parts):
        own = whitening.Moments.empty(3)
        own.sums = own.sums + whitening.exact_sums(part)
        own.update(part.astype(float))
        total.merge(own)
    c = m - m.mean(0)
    assert total.n == len(m) and total.sums.tolist() == m.sum(0).tolist()
    assert np.allclose(total.m2, c.T @ c, rtol=1e-9, atol=1e-3)
