"""FITS in and out, configurations, and whole runs from files."""

import os
import warnings

import numpy as np
import pytest

from faradeon.functions import generators as g
from faradeon.plans import config, pipeline
from faradeon.sources import fits, fits_format, text

BASE = """
path = {d}   # where the cubes are
infileQ = q.fits
infileU = u.fits
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
beg_rm = -50
end_rm = 50
nrm = 201
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("fits")
    _, q, u = g.two_sources()
    q, u = g.with_bad_channels(q, u)
    head = g.cube_header(32, 32, 550e6, 1e6)
    g.write_cube(str(d / "q.fits"), q, head)
    g.write_cube(str(d / "u.fits"), u, head)
    (d / "bad.txt").write_text("7\n9.8\n\n")
    return d


def test_cube_reader(spark, folder):
    fits.register(spark)
    df = spark.read.format("fits_cube").option("q", str(folder / "q.fits")).option("u", str(folder / "u.fits")).option("strip_bytes", 200_000).load()
    assert df.rdd.getNumPartitions() > 3
    r = df.where("x = 13 and y = 11").first()
    assert len(r["q"]) == 200 and np.isnan(r["q"][50]) and r["q"][0] == pytest.approx(np.cos(-10 * (299.792458 / 550) ** 2), abs=0.05)
    assert df.count() == 1024
    assert df.where("y between 3 and 4 and x > 30").count() == 4
    box = spark.read.format("fits_cube").option("q", str(folder / "q.fits")).option("x_first", 3).option("x_last", 9).option("x_step", 3).option("chan_step", 50).load()
    assert box.where("y = 1").count() == 3 and len(box.first()["q"]) == 4
    with pytest.raises(Exception, match="isn't within"):
        spark.read.format("fits_cube").option("q", str(folder / "q.fits")).option("x_last", 99).load().count()


def test_image_and_table(spark, tmp_path):
    fits.register(spark)
    data = np.arange(12, dtype=">i2").reshape(3, 4)
    body = data.tobytes()
    head = fits_format.header_bytes(fits_format.primary_cards(16, [4, 3], {"BSCALE": 2.0, "BZERO": 1.0, "BLANK": 5}))
    path = str(tmp_path / "i.fits")
    with open(path, "wb") as f:
        f.write(head + body.ljust(2880, b"\0"))
        rec = np.array([(1, 2.5, b"ab", [1, 2]), (3, -1.0, b"c", [3, 4])], [("a", ">i4"), ("b", ">f8"), ("c", "S4"), ("d", ">i2", 2)])
        cards = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": rec.itemsize, "NAXIS2": 2, "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": 4}
        cards |= {f"T{k}{n}": v for n, (name, form) in enumerate((("a", "J"), ("b", "D"), ("c", "4A"), ("d", "2I")), 1) for k, v in (("TYPE", name), ("FORM", form))}
        f.write(fits_format.header_bytes(cards) + rec.tobytes().ljust(2880, b"\0"))
    img = {(r["x"], r["y"]): r["val"] for r in spark.read.format("fits_image").option("path", path).load().collect()}
    assert img[2, 1] == 3 and np.isnan(img[2, 2]) and img[4, 3] == 23 and len(img) == 12
    rows = [tuple(r) for r in spark.read.format("fits_table").option("path", path).option("columns", "a,b,c,d").load().collect()]
    assert rows == [(1, 2.5, "ab", [1, 2]), (3, -1.0, "c", [3, 4])]
    assert spark.read.format("fits_table").option("path", path).option("columns", "b").load().columns == ["b"]


def test_headers():
    assert fits_format._value("'it''s'   / c") == "it's" and fits_format._value("T / x") is True and fits_format._value("1.5D3") == 1500.0
    with pytest.raises(fits_format.FitsError):
        fits_format.Header({"NAXIS": 1, "NAXIS1": 3, "CTYPE1": "RA"}).freq_axis()


def test_run_from_a_configuration(spark, folder):
    cfg = config.parse(BASE.format(d=folder) + "cubestat = y\n")
    p = pipeline.plan(spark, cfg)
    assert p.n_bad == 2 and len(p.axes.rm) == 201
    stats = {(r["x"], r["y"]): r for r in pipeline.maps(spark, p).collect()}
    for (x, y), rm, peak in (((13, 11), -5.0, 1.0), ((23, 21), 22.0, 0.8)):
        assert stats[x, y]["rm_peak"] == pytest.approx(rm, abs=1) and stats[x, y]["peak"] == pytest.approx(peak, abs=0.02)
    assert stats[26, 26]["peak"] is None and stats[26, 26]["nvalid"] == 0
    assert stats[13, 11]["nvalid"] == 197 and stats[1, 1]["nvalid"] == 198
    targets = pipeline.run(spark, cfg)
    assert sorted(targets) == ["amp", "ang", "ang_peak", "nvalid", "peak", "rm_peak", "snr", "w"]
    with open(targets["amp"], "rb") as f:
        h = fits_format.read_header(f)
        cube = fits_format.read_box(f, h, fits_format.Box([(13, 13, 1), (11, 11, 1), (1, 201, 1)])).ravel()
    assert h["CTYPE3"] == "FDEP" and h["CRVAL3"] == -50.0 and h["CDELT3"] == 0.5 and h["NBADGLOB"] == 2
    assert cube.argmax() == 90
    with open(targets["w"], "rb") as f:
        h = fits_format.read_header(f)
        w = fits_format.read_box(f, h, fits_format.Box([(13, 13, 1), (11, 11, 1), (1, 200, 1)])).ravel()
    assert (w[50], w[6], w[8], w.sum()) == (0, 0, 0, 197)
    with pytest.raises(FileExistsError):
        pipeline.run(spark, cfg)
    with open(targets["nvalid"], "rb") as f:
        h = fits_format.read_header(f)
        n = fits_format.read_box(f, h, fits_format.Box([(1, 32, 1), (1, 32, 1)]))
    assert h["BITPIX"] == 16 and n.reshape(32, 32)[25, 25] == 0 and n.reshape(32, 32)[10, 12] == 197
    with open(targets["rm_peak"], "rb") as f:
        h = fits_format.read_header(f)
        found = fits_format.read_box(f, h, fits_format.Box([(13, 13, 1), (11, 11, 1)])).ravel()[0]
    assert found == pytest.approx(stats[13, 11]["rm_peak"])
    folder_ = os.path.dirname(cfg.outfile)
    depths = [float(x) for x in open(f"{folder_}/sampled_RM.txt") if x[0] != "#"]
    assert np.allclose(depths, p.axes.rm)
    rows = [x.split() for x in open(f"{folder_}/sampled_freq.txt") if x[0] != "#"]
    assert len(rows) == 200 and sum(int(r[2]) for r in rows) == 198 and np.allclose([float(r[1]) for r in rows], p.axes.lsq)


def test_timing_record_and_reports(spark, folder, tmp_path):
    text_ = BASE.format(d=folder).replace(f"{folder}/out", f"{tmp_path}/out")
    assert str(tmp_path) in text_
    cfg = config.parse(text_ + f"timing_enabled = y\ntiming_csv_file = {tmp_path}/timing.csv\noutput_mode = ri\ncubestat = y\n")
    targets = pipeline.run(spark, cfg)
    assert {"re", "im", "peak"} <= set(targets)
    r = text.read_timing(spark, f"{tmp_path}/timing.csv").collect()
    assert len(r) == 1 and (r[0]["cube_nx"], r[0]["cube_nchan"], r[0]["cube_nrm"]) == (32, 200, 201) and r[0]["stage_total_sec"] >= r[0]["tile_total_sec"] > 0
    assert r[0]["tile_compute_sec"] > 0 and r[0]["tile_cubestat_sec"] > 0 and r[0]["tile_prep_sec"] > 0
    dry = config.parse(BASE.format(d=folder).replace(f"{folder}/out", f"{tmp_path}/dry") + "dry_run = y\n")
    files = pipeline.run(spark, dry)
    hints = dict(x.strip().split("=") for x in open(files["tile_autotune"]) if x[0] != "#")
    assert (hints["subim_ra_blc"], hints["subim_ra_trc"], hints["tile_auto"]) == ("1", "32", "n")
    assert "depths: 201" in open(files["runtime_estimate"]).read()
    assert not os.path.exists(f"{tmp_path}/dry.AMP.RMCUBE.FITS")


def test_sub_image_and_dry_run(spark, folder):
    cfg = config.parse(BASE.format(d=folder).replace("subim = n", "subim = y").replace("rem_mean = 0", "rem_mean = 1") + "subim_ra_blc=10\nsubim_ra_trc=20\nsubim_ra_inc=2\nsubim_chan_blc=1\nsubim_chan_inc=2\noutput_mode=ri")
    p = pipeline.plan(spark, cfg)
    assert p.shape == (6, 32) and len(p.axes.lsq) == 100
    got = {r["metric"]: r["value"] for r in pipeline.dry_run(spark, cfg).collect()}
    assert got["pixels"] == 192 and got["operations"] == 8 * 192 * got["good_channels"] * 201 + 4 * 192 * 201
    assert got["seconds_at_4_gflops"] == pytest.approx(got["operations"] / 4e9)
    assert len(pipeline.faraday(spark, p).first()["re"]) == 201


def test_strips():
    assert [(s.y0, s.y1) for s in fits.strips(1, 10, 100, 400)] == [(1, 4), (5, 8), (9, 10)]
    assert len(fits.strips(1, 3, 10**12)) == 3
    parts = fits.strips(1, 2, 1000, 300, 10)
    assert [(s.y0, s.y1, s.x0, s.x1) for s in parts] == [(y, y, a, b) for y in (1, 2) for a, b in ((1, 3), (4, 6), (7, 9), (10, 10))]


def test_rows_too_wide_for_a_task_are_split(spark, folder, tmp_path):
    """The same pixels whether rows are split or not, of cubes with strides and of images."""
    fits.register(spark)
    read = lambda size: spark.read.format("fits_cube").option("q", str(folder / "q.fits")).option("x_first", 2).option("x_step", 3).option("y_last", 4).option("chan_step", 40).option("strip_bytes", size).load()
    split, whole = read(100), read(1 << 26)
    assert split.rdd.getNumPartitions() > 4 * whole.rdd.getNumPartitions()
    assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect())) and split.count() == 44
    path = str(tmp_path / "v.fits")
    sink(pixels(spark, 7, 5, 1).selectExpr("x", "y", "float(n) v"), [product(path, naxes=(7, 5))])
    image = lambda size: spark.read.format("fits_image").option("path", path).option("x_first", 2).option("strip_bytes", size).load()
    assert sorted(map(tuple, image(16).collect())) == sorted(map(tuple, image(1 << 20).collect())) and image(16).rdd.getNumPartitions() == 15


@pytest.mark.parametrize(
    "change",
    ["surprise = 1", "nrm = 3", "max_rm = 9", "ofac = 0", "output_mode = zz", "log_level = warning", "mem_frac_ram = 0.96", "subim_ra_blc = 0", "tile_ra = -1", "nrm_out = 0", "end_rm = -60", "use_auto_rm_range = 2", "remove_qu_bias = y", "infileQ =", "subim_dec_inc = 0", "ofac = many"],
)
def test_rejected_configurations(change):
    key = change.split("=")[0].strip()
    doubles = change in ("nrm = 3", "max_rm = 9")
    lines = [x for x in BASE.format(d="/d").splitlines() if doubles or not x.lower().startswith(key.lower() + " ")]
    if key == "nrm_out":
        lines = [x for x in lines if not x.startswith("nrm")]
    with pytest.raises(config.ConfigError):
        config.parse("\n".join([*lines, change]))


def test_accepted_configurations():
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        cfg = config.parse(BASE.format(d="/d") + "USE_GPU = yes ; no effect\nlog_level = DEBUG\nnonsense line\nempty =\n")
    assert cfg.use_gpu and cfg.log_level == "debug" and cfg.path == "/d" and seen
    assert config.parse(BASE.format(d="/d")).end_rm == 50
    assert dict(config.as_rows(cfg))["nrm"] == "201"


def test_text_files(spark, tmp_path):
    (tmp_path / "b").write_text("161\n178.9\nx\n")
    assert text.bad_channels(spark, str(tmp_path / "b"), 200) == [161, 178]
    assert text.bad_channels(spark, str(tmp_path / "none"), 200) == []
    with pytest.raises(ValueError):
        text.bad_channels(spark, str(tmp_path / "b"), 2)
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "1").write_text("chan value\n1 2.5\n2 nan\n")
    (tmp_path / "c" / "2").write_text("3 -1d\n\n4 7e2 x\n")
    got = sorted((r["line"], r["value"]) for r in text.column(spark, str(tmp_path / "c"), 2).collect())
    assert [i for i, _ in got] == list(range(len(got))) and {repr(v) for _, v in got} >= {"2.5", "nan", "700.0"}
    names = [c.split() for c in text.TIMING.split(", ")]
    row = spark.createDataFrame([tuple("r" if t == "string" else 1 if t in ("int", "long") else 0.5 for _, t in names)], text.TIMING)
    for _ in range(2):
        text.append_timing(row, str(tmp_path / "t"))
    assert text.read_timing(spark, str(tmp_path / "t")).count() == 2 and len(names) == 27
    text.write_axis(spark.range(3).toDF("rm"), str(tmp_path / "axis"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "axis")).collect()) == ["0", "1", "2"]
    text.export_long(spark.range(2), str(tmp_path / "long"))
    assert os.path.isdir(tmp_path / "long")


def pixels(spark, nx, ny, planes, partitions=3):
    from pyspark.sql import functions as F

    k = F.col("id")
    values = F.transform(F.sequence(F.lit(1), F.lit(planes)), lambda p: (k * 10 + p).cast("float"))
    return spark.range(nx * ny).repartition(partitions).select((k % nx + 1).cast("int").alias("x"), (F.floor(k / nx) + 1).cast("int").alias("y"), values.alias("v"), (k % 251).cast("int").alias("n"))


def sink(df, products, mode="append", **options):
    import json

    w = df.write.format("fits_output").mode(mode).option("products", json.dumps(products))
    for k, v in options.items():
        w = w.option(k, v)
    w.save()


def product(path, column="v", naxes=(7, 5, 4), bitpix=-32):
    return {"path": str(path), "column": column, "naxes": list(naxes), "bitpix": bitpix}


def test_commit_names_whole_files_with_their_sums(spark, tmp_path, monkeypatch):
    fits.register(spark)
    two = [product(tmp_path / "v.fits"), product(tmp_path / "n.fits", "n", (7, 5), 8)]
    (tmp_path / ".v.fits.lostjob.staged").write_text("of a job that was lost")
    sink(pixels(spark, 7, 5, 4), two)
    assert sorted(os.listdir(tmp_path)) == ["n.fits", "v.fits"]
    for name in ("v.fits", "n.fits"):
        r = fits.verified(spark, str(tmp_path / name), chunk=8).first()
        with open(tmp_path / name, "rb") as f:
            h = fits_format.read_header(f)
            f.seek(h.data_at)
            words = np.frombuffer(f.read(), ">u4").astype(object).sum()
        assert r["ok"] and r["stated"] == fits.folded(int(words)) == int(h["DATASUM"]) > 0
    with open(tmp_path / "v.fits", "rb") as f:
        got = fits_format.read_box(f, fits_format.read_header(f), fits_format.Box([(1, 7, 1), (1, 5, 1), (1, 4, 1)]))
    assert got.tolist() == (np.arange(35).reshape(1, 5, 7) * 10 + np.arange(1, 5)[:, None, None]).tolist()
    with open(tmp_path / "v.fits", "r+b") as f:  # a byte that changes later shows
        f.seek(h.data_at + 9)
        f.write(b"\x55")
    assert not fits.verified(spark, str(tmp_path / "v.fits")).first()["ok"]
    with pytest.raises(Exception, match="exists"):
        sink(pixels(spark, 7, 5, 4), two)
    sink(pixels(spark, 7, 5, 4), two, "overwrite")
    assert fits.verified(spark, str(tmp_path / "v.fits")).first()["ok"] and len(os.listdir(tmp_path)) == 2


@pytest.mark.parametrize("change, says", [("gap", "written twice in 1 of 5 rows, the first of them 3"), ("twice", "written twice in 5 of 5"), ("outside", "outside of 7 x 5"), ("planes", "hasn't 4 planes"), ("task", "lost task")])
def test_what_is_not_whole_leaves_no_file(spark, tmp_path, change, says):
    from pyspark.sql import functions as F

    df = pixels(spark, 7, 5, 3 if change == "planes" else 4)
    if change == "gap":
        df = df.where("not (x = 2 and y = 3)")
    if change == "twice":
        df = df.unionByName(df)
    if change == "outside":
        df = df.withColumn("y", F.col("y") + 1)
    if change == "task":

        def broken(batches):
            for b in batches:
                if 9 in b.column(0).to_pylist():
                    raise RuntimeError("lost task")
                yield b

        df = df.withColumn("z", F.col("x") + 7 * (F.col("y") - 1)).select("z", "x", "y", "v", "n").mapInArrow(broken, "z int, x int, y int, v array<float>, n int").drop("z")
    with pytest.raises(Exception, match=says):
        sink(df, [product(tmp_path / "v.fits"), product(tmp_path / "n.fits", "n", (7, 5), 16)])
    assert os.listdir(tmp_path) == []
    if change == "gap":
        sink(df, [product(tmp_path / "v.fits")], gaps="allow")
        assert fits.verified(spark, str(tmp_path / "v.fits")).first()["ok"]


def test_of_several_products_all_are_there_or_none(spark, tmp_path):
    """Another job has put a file of that name there between the start and the commit."""

    def late(batches):
        (tmp_path / "n.fits").write_text("another's")
        yield from batches

    df = pixels(spark, 7, 5, 4).mapInArrow(late, "x int, y int, v array<float>, n int")
    with pytest.raises(Exception, match="n.fits exists"):
        sink(df, [product(tmp_path / "v.fits"), product(tmp_path / "n.fits", "n", (7, 5), 8)])
    assert os.listdir(tmp_path) == ["n.fits"] and (tmp_path / "n.fits").read_text() == "another's"


def test_a_lost_driver_leaves_no_final_file(spark, tmp_path):
    import signal
    import subprocess
    import sys
    import time

    code = f"""
import sys, time
sys.path.insert(0, {str(os.path.dirname(os.path.dirname(os.path.abspath(fits.__file__))).rsplit('/', 1)[0])!r})
from pyspark.sql import SparkSession
from faradeon.sources import fits
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
fits.register(s)
def slow(batches):
    for b in batches:
        yield b
        open({str(tmp_path / 'began')!r}, "w").close()
        time.sleep(600)
df = s.range(35).selectExpr("int(id % 7 + 1) x", "int(id / 7 + 1) y", "float(id) v").mapInArrow(slow, "x int, y int, v float")
df.write.format("fits_output").mode("append").option("path", {str(tmp_path / 'v.fits')!r}).option("naxes", "7,5").option("column", "v").save()
"""
    run = subprocess.Popen([sys.executable, "-c", code], start_new_session=True, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    until = time.time() + 120
    while not (tmp_path / "began").exists() and run.poll() is None and time.time() < until:
        time.sleep(0.2)
    os.killpg(run.pid, signal.SIGKILL)
    run.wait()
    assert (tmp_path / "began").exists() and not (tmp_path / "v.fits").exists()
    assert any(n.endswith(fits.STAGED) for n in os.listdir(tmp_path))
    sink(pixels(spark, 7, 5, 1).selectExpr("x", "y", "float(n) v"), [product(tmp_path / "v.fits", naxes=(7, 5))])
    assert sorted(os.listdir(tmp_path)) == ["began", "v.fits"]


def test_strips_are_pruned(spark, tmp_path):
    from faradeon.sources.strips import read_strips, write_strips

    path = str(tmp_path / "s")
    write_strips(pixels(spark, 9, 40, 2), path, rows=8)
    assert sorted(os.listdir(f"{path}/rows=8")) == [f"y0={k}" for k in (1, 17, 25, 33, 9)]
    part = read_strips(spark, path, x=(2, 3), y=(20, 26))
    assert {f.split("y0=")[1].split("/")[0] for f in part.inputFiles()} <= {"1", "9", "17", "25", "33"}
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "y0" in plan.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(y,20)" in plan
    rows = part.collect()
    assert {(r["x"], r["y"]) for r in rows} == {(x, y) for x in (2, 3) for y in range(20, 27)} and part.columns == ["x", "y", "v", "n"]
    assert read_strips(spark, path).count() == 360
    with pytest.raises(Exception, match="already exists"):
        write_strips(pixels(spark, 9, 40, 2), path, rows=8)
