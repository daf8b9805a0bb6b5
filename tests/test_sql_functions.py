"""Functions called from SQL: what they refuse, and results that don't depend on batches or the order of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faradeon.functions import generators as g
from faradeon.functions import sql


@pytest.fixture(scope="module")
def samples(spark):
    sql.register(spark)
    rng = np.random.default_rng(2)
    rows = [(x, y, float(700 + 4 * k), float(rng.normal()), float(rng.normal()), 1.0, "other") for x in range(3) for y in range(2) for k in range(64)]
    rows += [(0, 0, 500.0, None, 1.0, 1.0, "n"), (0, 0, 501.0, float("nan"), 1.0, 1.0, "n"), (9, 9, 700.0, None, None, 1.0, "n")]
    df = spark.createDataFrame(rows, "x int, y int, freq double, q double, u double, w double, extra string")
    df.createOrReplaceTempView("t_samples")
    return df


CALL = "rm_synthesis(TABLE({t}) PARTITION BY (x, y), beg => -20D, end => 20D, n => 21)"


def test_bad_samples_and_pixels_without_good_ones(spark, samples):
    rows = spark.sql(f"SELECT * FROM {CALL.format(t='t_samples')}").collect()
    assert len(rows) == 7 * 21
    assert all(r["re"] is None and r["w"] == 0 for r in rows if r["x"] == 9) and {r["w"] for r in rows if r["x"] != 9} == {64}


def test_batches_and_order_change_nothing(spark, samples):
    want = {(r["x"], r["y"], r["irm"]): (r["re"], r["im"]) for r in spark.sql(f"SELECT * FROM {CALL.format(t='t_samples')}").collect()}
    samples.repartition(5).orderBy(F.rand(3)).createOrReplaceTempView("t_shuffled")
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, 7)
    try:
        got = {(r["x"], r["y"], r["irm"]): (r["re"], r["im"]) for r in spark.sql(f"SELECT * FROM {CALL.format(t='t_shuffled')}").collect()}
    finally:
        spark.conf.set(key, before)
    assert got.keys() == want.keys()
    assert all(a == b or np.allclose(a, b) for a, b in ((got[k], want[k]) for k in want))


@pytest.mark.parametrize(
    "call, says",
    [
        ("rm_synthesis(TABLE(t_samples), beg => -20D, end => 20D, n => 21)", "add PARTITION BY"),
        ("rm_synthesis(TABLE(SELECT x, y, q FROM t_samples) PARTITION BY (x, y), beg => -20D, end => 20D, n => 21)", "no column u, lsq"),
        ("rm_synthesis(TABLE(t_samples) PARTITION BY (x, y), beg => 20D, end => -20D, n => 21)", "21 depths from 20.0 to -20.0"),
        ("peak_map(TABLE(t_samples) PARTITION BY (x, y))", "no column rm, re, im"),
        ("fits_header(cast(null as string))", "constant path"),
    ],
)
def test_refused_calls(spark, samples, call, says):
    with pytest.raises(Exception, match=says):
        spark.sql(f"SELECT * FROM {call}").collect()


def test_headers(spark, samples, tmp_path):
    path = str(tmp_path / "q.fits")
    g.write_cube(path, np.zeros((4, 3, 2), np.float32), g.cube_header(2, 3, 550e6, 1e6))
    cards = {r["key"]: (r["value"], r["kind"]) for r in spark.sql(f"SELECT * FROM fits_header('{path}')").collect()}
    assert cards["NAXIS1"][1] == "int" and cards["CRVAL3"] == ("550000000.0", "float")
    one = spark.sql(f"SELECT * FROM fits_header('{path}', keys => 'naxis1, CRVAL3, SIMPLE, ctype3, none')")
    assert [t for _, t in one.dtypes] == ["bigint", "double", "boolean", "string", "string"]
    assert one.first()["CRVAL3"] == 550e6 and one.first()["NONE"] is None
