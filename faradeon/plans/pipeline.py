"""From a run configuration to Faraday cubes and maps: sources, mask, transform, statistics, sinks, dry run."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.axes import C_MHZ, Axes, auto_rm_range, channel_frequencies, frequency_unit, lambda_squared, rm_axis
from ..operators import cubestat
from ..operators.mask import SENTINEL, check_range, compatible
from ..operators.synthesis import Kernel, bounded_spectra, matrix, rows_of, synthesise
from ..sources.fits import STRIP_BYTES, register, row_bytes
from ..sources.fits_format import Header, read_header
from ..sources.strips import write_strips
from ..sources.text import append_timing, bad_channels, timing_record
from . import wcs
from .config import RunConfig

#: Speeds at which the cost model quotes run times, in 10^9 operations a second; fixed values.
SPEEDS = (1, 2, 4, 8, 12)
#: Maps of peaks, in the order of cubestat.peak_of.
MAPS = ("peak", "rm_peak", "ang_peak", "snr")


@dataclass(frozen=True)
class Plan:
    """What a run reads and makes, from headers alone."""

    cfg: RunConfig
    header: Header
    box: dict[str, tuple[int, int, int]]
    axes: Axes
    n_bad: int

    @property
    def shape(self) -> tuple[int, int]:
        return tuple((self.box[k][1] - self.box[k][0]) // self.box[k][2] + 1 for k in ("x", "y"))


def describe(h: Header) -> dict:
    """What two cubes must have in common."""
    n = range(1, len(h.naxes) + 1)
    return {"naxis": len(h.naxes), "naxes": h.naxes, "freq_axis": h.freq_axis(), "crval": [h.get(f"CRVAL{k}") for k in n], "crpix": [h.get(f"CRPIX{k}") for k in n], "cdelt": [h.get(f"CDELT{k}") for k in n]}


def input_paths(cfg: RunConfig) -> dict[str, str]:
    out = {"q": os.path.join(cfg.path, cfg.infileq), "u": os.path.join(cfg.path, cfg.infileu)}
    if cfg.remove_qu_bias:
        out["i"] = os.path.join(cfg.path_i or cfg.path, cfg.infilei)
    if cfg.mask_input_cube_file:
        out["mask"] = cfg.mask_input_cube_file
    return out


def plan(spark: SparkSession, cfg: RunConfig, compat: bool = False) -> Plan:
    """Check the inputs against each other and resolve the sub-image, the axes and the bad channels."""
    heads = {}
    for name, path in input_paths(cfg).items():
        with open(path, "rb") as f:
            heads[name] = read_header(f)
    q = heads["q"]
    for name, h in heads.items():
        a, b = describe(q), describe(h)
        compatible(a if name != "mask" else {"naxes": a["naxes"]}, b if name != "mask" else {"naxes": b["naxes"]})
    axis, naxes = q.freq_axis(), q.naxes
    box = {}
    for name, key, size in (("x", "ra", naxes[0]), ("y", "dec", naxes[1]), ("chan", "chan", naxes[axis - 1])):
        first, last, step = (getattr(cfg, f"subim_{key}_{k}") for k in ("blc", "trc", "inc")) if cfg.subim else (1, 0, 1)
        first = max(first, 1)
        box[name] = (first, check_range(key, first, last, step, size), step)
    freq = channel_frequencies(float(q[f"CRVAL{axis}"]), float(q.get(f"CRPIX{axis}", 1)), float(q[f"CDELT{axis}"]), naxes[axis - 1])
    bad = set(bad_channels(spark, cfg.badchan_file, len(freq))) if cfg.remove_badchan else set()
    first, last, step = box["chan"]
    picks = np.arange(first, last + 1, step)
    own = freq[picks - 1]
    if cfg.use_auto_rm_range:
        rm = rm_axis(*auto_rm_range(own, cfg.fac, compat), len(own) * cfg.ofac)
    else:
        rm = rm_axis(cfg.beg_rm, cfg.end_rm, cfg.nrm * cfg.ofac)
    good = np.array([int(p) not in bad for p in picks])
    return Plan(cfg, q, box, Axes(lambda_squared(own), rm, good), int((~good).sum()))


def load(spark: SparkSession, p: Plan, compat: bool = False) -> DataFrame:
    """x, y and arrays q, u, w by channel: bias and mask applied, straight from the files' strips."""
    register(spark)
    cfg, reader = p.cfg, spark.read.format("fits_cube")
    for name, path in input_paths(cfg).items():
        reader = reader.option(name, path)
    for name, (first, last, step) in p.box.items():
        for key, value in (("first", first), ("last", last), ("step", step)):
            reader = reader.option(f"{name}_{key}", value)
    return weighted_spectra(reader.load(), cfg, p.axes.good, compat)


def weighted_spectra(df: DataFrame, cfg: RunConfig, good: np.ndarray, compat: bool = False) -> DataFrame:
    """Arrays q, u, w: w is 0 for bad channels, NaN (unless ``compat`` and trust 'strict'), -999 and mask values up to 0.5."""
    if cfg.remove_qu_bias:
        fix = lambda s, slope, resi: F.zip_with(s, "i", lambda v, i: v - (i * F.when(v >= resi, slope).otherwise(-slope) + resi))
        df = df.withColumn("q", fix("q", cfg.slopeq, cfg.resiq)).withColumn("u", fix("u", cfg.slopeu, cfg.resiu))
    null = lambda v: F.abs(v - SENTINEL) < 1e-6
    bad = lambda v: null(v) if compat and cfg.mask_trust_mode == "strict" else v.isNull() | F.isnan(v) | null(v)
    flags = F.array(*[F.lit(int(g)) for g in good])
    w = F.zip_with(F.zip_with("q", "u", lambda a, b: F.when(bad(a) | bad(b), 0).otherwise(1)), flags, lambda a, b: a * b)
    if "m" in df.columns:
        w = F.zip_with(w, "m", lambda a, m: F.when(m > 0.5, a).otherwise(0))
    return df.select("x", "y", "q", "u", w.alias("w"))


def faraday(spark: SparkSession, p: Plan) -> DataFrame:
    return synthesise(load(spark, p), p.axes, p.cfg.output_mode, p.cfg.ap_angle_mode, p.cfg.rem_mean > 0)


def maps(spark: SparkSession, p: Plan) -> DataFrame:
    """Peak maps, always of the amplitude, whatever the output mode is."""
    return cubestat.peak_maps(synthesise(load(spark, p), p.axes, "ap", p.cfg.ap_angle_mode, p.cfg.rem_mean > 0, "double"), p.axes.rm)


def outputs(cfg: RunConfig) -> dict[str, str]:
    """Paths of the products by name."""
    two = {"amp": ".AMP.RMCUBE.FITS", "ang": ".POLA.RMCUBE.FITS" if cfg.ap_angle_mode == "pol" else ".PHA.RMCUBE.FITS"} if cfg.output_mode == "ap" else {"re": ".REAL.RMCUBE.FITS", "im": ".IMAG.RMCUBE.FITS"}
    out = {k: cfg.outfile + v for k, v in two.items()}
    if cfg.write_mask_output:
        out["w"] = cfg.mask_cube_file or cfg.outfile + ".MASK.FITS"
    if cfg.write_nvalid_output:
        out["nvalid"] = cfg.outfile + ".NVALID.FITS"
    if cfg.cubestat:
        out |= {k: f"{cfg.outfile}.{v}.FITS" for k, v in (("peak", "PEAK"), ("rm_peak", "RM_PEAK"), ("ang_peak", "ANG_PEAK"), ("snr", "SNR"))}
    return out


def products(df: DataFrame, p: Plan, names: list[str], precision: str = "float", timers: dict | None = None) -> DataFrame:
    """x, y and the named products of pixels with arrays q, u, w, all from one transform; maps are of the amplitude.

    ``timers``: accumulators for the seconds that tasks spend on tile_prep_sec, tile_compute_sec and tile_cubestat_sec, repeated attempts included.
    """
    cfg, axes, real = p.cfg, p.axes, pa.float64() if precision == "double" else pa.float32()
    kinds = {k: f"array<{precision}>" for k in ("amp", "ang", "re", "im")} | {"w": "array<tinyint>", "nvalid": "int"} | {k: precision for k in MAPS}
    bounded_spectra(df.sparkSession, len(axes.lsq))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel(axes, np.float64 if cfg.cubestat or precision == "double" else np.float32)
        for b in batches:
            if not b.num_rows:
                continue
            at = [time.perf_counter()]
            q, u, w = (matrix(b.column(k), None) for k in (2, 3, 4))
            at.append(time.perf_counter())
            re, im, total = kernel(q, u, w, cfg.rem_mean > 0)
            at.append(time.perf_counter())
            out: dict[str, pa.Array] = {"w": rows_of(np.where(axes.good, w, 0), pa.int8()), "nvalid": pa.array(total.astype(np.int32))}
            if cfg.output_mode == "ap" or cfg.cubestat:
                amp, ang = np.hypot(re, im), np.arctan2(im, re) * (0.5 if cfg.ap_angle_mode == "pol" else 1)
                out |= {"amp": rows_of(amp, real), "ang": rows_of(ang, real)}
                if cfg.cubestat:
                    out |= {k: pa.array(v, real) for k, v in zip(MAPS, cubestat.peak_of(amp, ang, axes.rm), strict=True)}
            out |= {"re": rows_of(re, real), "im": rows_of(im, real)} if cfg.output_mode == "ri" else {}
            at.append(time.perf_counter())
            for k, timer in enumerate((timers or {}).values()):
                timer.add(at[k + 1] - at[k])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(out[k] for k in names)], names=["x", "y", *names])

    return df.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "q", "u", "w").mapInArrow(make, ", ".join(["x int", "y int", *(f"{k} {kinds[k]}" for k in names)]))


def run(spark: SparkSession, cfg: RunConfig, compat: bool = False) -> dict[str, str]:
    """Make all products of a configuration; a product that exists already stops the run before anything is written.

    The cubes are read once and transformed once, and all products are written from that pass. Counts of valid
    channels are 16-bit, unless there are more channels than that holds. Beside the products, the axes are written as text, and with
    ``timing_enabled`` a timing record is appended to ``timing_csv_file``; with ``dry_run`` only its two reports are.
    """
    began = time.time()
    if cfg.dry_run:
        return write_reports(spark, cfg, compat)
    p, targets = plan(spark, cfg, compat), outputs(cfg)
    if there := [t for t in targets.values() if os.path.exists(t)]:
        raise FileExistsError(", ".join(there))
    nx, ny = p.shape
    head = dict(p.header.cards)
    x, y = ((p.box[k][0], p.box[k][2]) for k in ("x", "y"))
    origin = wcs.provenance(cfg.mask_input_cube_file or "none", p.n_bad, not (compat and cfg.mask_trust_mode == "strict"), cfg.mask_trust_mode, cfg.cubestat)
    axis = p.header.freq_axis()
    unit = "MHz" if frequency_unit(float(head[f"CRVAL{axis}"])) == 1 else "Hz"
    freq = wcs.frequency_axis(float(head[f"CRVAL{axis}"]), float(head.get(f"CRPIX{axis}", 1)), float(head[f"CDELT{axis}"]), p.box["chan"][0], p.box["chan"][2], unit)

    def product(name: str) -> dict:
        third, n = (freq, len(p.axes.lsq)) if name == "w" else (wcs.depth_axis(p.axes.rm), len(p.axes.rm)) if name in ("amp", "ang", "re", "im") else (None, 1)
        bitpix = 8 if name == "w" else (16 if len(p.axes.lsq) < 1 << 15 else 32) if name == "nvalid" else -32
        return {"path": targets[name], "column": name, "naxes": [nx, ny, n] if third else [nx, ny], "bitpix": bitpix, "cards": wcs.output_cards(head, x, y, third) | origin}

    planned = time.time()
    timers = {k: spark.sparkContext.accumulator(0.0) for k in ("tile_prep_sec", "tile_compute_sec", "tile_cubestat_sec")} if cfg.timing_enabled else None
    made = products(load(spark, p, compat), p, list(targets), timers=timers)
    made.write.format("fits_output").mode("append").option("products", json.dumps([product(name) for name in targets])).save()
    ended = time.time()
    write_axes(p, os.path.dirname(cfg.outfile) or ".")
    if cfg.timing_enabled and cfg.timing_csv_file:
        size = {"cube_nx": nx, "cube_ny": ny, "cube_nchan": len(p.axes.lsq), "cube_nrm": len(p.axes.rm), "tile_ra": nx, "tile_dec": strip_rows(p)}
        times = {"stage_total_sec": time.time() - began, "header_sec": planned - began, "tile_total_sec": ended - planned, "finalize_sec": time.time() - ended} | {k: v.value for k, v in (timers or {}).items()}
        io = {"io_read_bytes": nx * ny * len(p.axes.lsq) * 4 * len(input_paths(cfg)), "io_write_bytes": sum(os.path.getsize(t) for t in targets.values())}
        append_timing(timing_record(spark, {"run_id": uuid.uuid4().hex, "mode": "spark"} | size | times | io), cfg.timing_csv_file)
    return targets


def run_strips(spark: SparkSession, cfg: RunConfig, path: str, rows: int | None = None, compat: bool = False, precision: str = "float") -> str:
    """The products of a configuration as Parquet by strips of the sky at ``path``, from one read and one transform.

    A strip has as many rows as a partition of the reader, unless ``rows`` says otherwise; nothing is shuffled. The
    depths and the channels are written beside it, at ``path`` and -depths and -channels.
    """
    p = plan(spark, cfg, compat)
    made = products(load(spark, p, compat), p, list(outputs(cfg)), precision)
    write_strips(made, path, rows or min(strip_rows(p), p.shape[1]), dealt=True)
    p.axes.depths(spark).write.parquet(f"{path}-depths")
    p.axes.channels(spark).write.parquet(f"{path}-channels")
    return path


def write_axes(p: Plan, folder: str) -> None:
    """sampled_RM.txt and sampled_freq.txt: the depths, and the channels with their wavelengths squared and flags."""
    cfg = p.cfg
    with open(os.path.join(folder, "sampled_RM.txt"), "w", encoding="utf-8") as f:
        f.writelines(f"# {k}: {v}\n" for k, v in (("ofac", cfg.ofac), ("ngood_chan", int(p.axes.good.sum())), ("nrm_out", len(p.axes.rm)), ("fac", cfg.fac), ("beg_rm", float(p.axes.rm[0]))))
        f.writelines(f"{v!r}\n" for v in p.axes.rm.tolist())
    with open(os.path.join(folder, "sampled_freq.txt"), "w", encoding="utf-8") as f:
        f.write("# freq       L_sq       flag (1=good, 0=bad)\n")
        f.writelines(f"{C_MHZ / v**0.5!r} {v!r} {int(g)}\n" for v, g in zip(p.axes.lsq.tolist(), p.axes.good.tolist(), strict=True))


def strip_rows(p: Plan) -> int:
    """Rows of the sky in a partition of the reader."""
    return max(1, STRIP_BYTES // max(1, row_bytes(p.shape[0], len(p.axes.lsq), len(input_paths(p.cfg)))))


def dry_run(spark: SparkSession, cfg: RunConfig, compat: bool = False) -> DataFrame:
    """metric, value: sizes, partitions and a lower bound of the operations of a run; nothing is read but headers."""
    p = plan(spark, cfg, compat)
    nx, ny = p.shape
    n_good, n_rm, pixels = int(p.axes.good.sum()), len(p.axes.rm), nx * ny
    work = 8 * pixels * n_good * n_rm + (12 if cfg.output_mode == "ap" else 4) * pixels * n_rm
    rows = strip_rows(p)
    out = [("pixels", pixels), ("channels", len(p.axes.lsq)), ("good_channels", n_good), ("depths", n_rm), ("strip_rows", rows), ("partitions", -(-ny // rows)), ("input_bytes", pixels * len(p.axes.lsq) * 8), ("output_bytes", pixels * n_rm * 8), ("operations", work)]
    out += [(f"seconds_at_{s}_gflops", work / s / 1e9) for s in SPEEDS]
    return spark.createDataFrame([(k, float(v)) for k, v in out], "metric string, value double")


def write_reports(spark: SparkSession, cfg: RunConfig, compat: bool = False) -> dict[str, str]:
    """Files of a dry run: tile_autotune.cfg, keys for a configuration of the same cut, and runtime_estimate.txt."""
    p = plan(spark, cfg, compat)
    folder, rows = os.path.dirname(cfg.outfile) or ".", strip_rows(p)
    (x0, x1, _), (y0, y1, dy) = p.box["x"], p.box["y"]
    hints = {"tile_auto": "n", "tile_ra": p.shape[0], "tile_dec": min(rows, p.shape[1]), "mem_frac_ram": cfg.mem_frac_ram, "mem_frac_vram": cfg.mem_frac_vram, "gpu_vram_mib": cfg.gpu_vram_mib}
    hints |= {"subim_ra_blc": x0, "subim_ra_trc": x1, "subim_dec_blc": y0, "subim_dec_trc": min(y1, y0 + (rows - 1) * dy)}
    out = {"tile_autotune": os.path.join(folder, "tile_autotune.cfg"), "runtime_estimate": os.path.join(folder, "runtime_estimate.txt")}
    with open(out["tile_autotune"], "w", encoding="utf-8") as f:
        f.write("# Keys of a partition's cut of the sky\n")
        f.writelines(f"{k}={v}\n" for k, v in hints.items())
    with open(out["runtime_estimate"], "w", encoding="utf-8") as f:
        f.writelines(f"{r['metric']}: {r['value']:.15g}\n" for r in dry_run(spark, cfg, compat).collect())
    return out
