"""Streams: stage times of a growing run log, and cubes that grow as channels arrive."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions.axes import templates
from ..operators import runlog


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events of log files as they come."""
    return runlog.parse(spark.readStream.text(folder))


def stage_windows(events: DataFrame, window: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Events and bytes by stage and event-time window; events later than ``late`` are left out."""
    timed = events.withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", late)
    return timed.groupBy(F.window("time", window).alias("w"), "stage").agg(F.count("*").alias("events"), F.sum("bytes").alias("bytes")).select(F.col("w.start").alias("start"), "stage", "events", "bytes")


def partial_sums(samples: DataFrame, channels: DataFrame, depths: DataFrame) -> DataFrame:
    """Additive sums by pixel and depth of long samples (x, y, chan, q, u, w): a live transform in update mode.

    a, b: sums of the numerators; sq, su, sc, ss, n: sums of q, u, cos, sin and w, with which ``finished`` can also
    take the means off. The state has a row for each pixel and depth.
    """
    wide = samples.join(F.broadcast(channels.select("chan", "lsq")), "chan").join(F.broadcast(depths.select("irm", "rm")))
    p, w = 2 * F.col("rm") * F.col("lsq"), F.col("w")
    s = lambda x, name: F.sum(w * x).alias(name)
    q, u, c, n = F.col("q"), F.col("u"), F.cos(p), F.sin(p)
    return wide.groupBy("x", "y", "irm", "rm").agg(s(q * c + u * n, "a"), s(u * c - q * n, "b"), s(q, "sq"), s(u, "su"), s(c, "sc"), s(n, "ss"), F.sum("w").alias("n"))


def live_spectra(samples: DataFrame, rm: np.ndarray) -> DataFrame:
    """x, y, re, im (arrays by depth), w of pixels whenever samples (x, y, lsq, q, u, w) of theirs have come, in update mode.

    A pixel's state is one row: its sums by depth as arrays, whatever the number of samples. It needs the RocksDB store
    (``runs.keyed_state``).
    """
    out = "x int, y int, re array<double>, im array<double>, w double"
    return samples.select("x", "y", "lsq", "q", "u", "w").groupBy("x", "y").transformWithStateInPandas(_Spectra(np.asarray(rm, np.float64)), out, "Update", "None")


class _Spectra(StatefulProcessor):
    def __init__(self, rm: np.ndarray):
        self.rm = rm

    def init(self, handle) -> None:
        self.sums = handle.getValueState("sums", "re array<double>, im array<double>, w double")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        re, im, total = self.sums.get() if self.sums.exists() else (np.zeros(len(self.rm)), np.zeros(len(self.rm)), 0.0)
        re, im = np.array(re), np.array(im)
        for part in rows:
            lsq, q, u, w = (part[c].to_numpy(np.float64) for c in ("lsq", "q", "u", "w"))
            q, u = np.where(w > 0, q, 0), np.where(w > 0, u, 0)
            c, s = templates(self.rm, lsq)
            re += c @ (w * q) + s @ (w * u)
            im += c @ (w * u) - s @ (w * q)
            total += float(w.sum())
        self.sums.update((re.tolist(), im.tolist(), total))
        share = 1 / total if total else np.nan
        yield pd.DataFrame({"x": [key[0]], "y": [key[1]], "re": [(re * share).tolist()], "im": [(im * share).tolist()], "w": [total]})

    def close(self) -> None:
        pass


def finished(sums: DataFrame, remove_mean: bool = False) -> DataFrame:
    """re and im from ``partial_sums``."""
    n = F.nullif("n", F.lit(0))
    a, b = F.col("a"), F.col("b")
    if remove_mean:
        q, u = F.col("sq") / n, F.col("su") / n
        a, b = a - q * F.col("sc") - u * F.col("ss"), b - u * F.col("sc") + q * F.col("ss")
    return sums.select("x", "y", "irm", "rm", (a / n).alias("re"), (b / n).alias("im"), F.col("n").cast("int").alias("w"))
