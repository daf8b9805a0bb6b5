"""Runs and intervals of streams against those of the same events as a batch."""

import random

import pytest
from pyspark.sql import functions as F

from faradeon import queries
from faradeon.operators import runlog
from faradeon.streaming import runs

COLUMNS = ["event_id", "ts", "tid", "stage", "event", "bytes"]


@pytest.fixture(scope="module")
def events(spark, tables):
    e = queries.log_events(spark, tables).select(*COLUMNS)
    marker = (F.col("event_id") % 23 == 5) & (F.col("tid") < 2)
    return e.withColumn("event", F.when(marker, "run_start").otherwise(F.col("event"))).toPandas().astype({"ts": "datetime64[us]"})


def played(spark, events, folder, make, delay_s, seed=1):
    """The rows of a stream of ``events`` that come in slices, out of order by less than ``delay_s``."""
    runs.keyed_state(spark)
    rng = random.Random(seed)
    rows = sorted(events.to_dict("records"), key=lambda r: r["ts"].timestamp() + rng.uniform(0, 0.9 * delay_s))
    schema = spark.createDataFrame(events).schema
    last, step = events["ts"].max(), __import__("pandas").Timedelta(days=1)
    close = [{"event_id": -k, "ts": last + k * step, "tid": t, "stage": "closing", "event": "none", "bytes": None} for k in (1, 2) for t in range(4)]
    size = -(-len(rows) // 7)
    for n, part in enumerate([rows[a : a + size] for a in range(0, len(rows), size)] + [close[:4], close[4:]]):
        rng.shuffle(part)
        spark.createDataFrame([tuple(None if r[c] != r[c] else r[c].to_pydatetime() if c == "ts" else r[c] for c in COLUMNS) for r in part], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    got = []
    q = make(stream).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    states = [o.numRowsTotal for p in q.recentProgress for o in p.stateOperators]
    return [r.asDict() for r in got], states


def key(r, names):
    return tuple(repr(r[n]) for n in names)


@pytest.mark.parametrize("marked", [True, False])
def test_runs_of_a_stream(spark, events, tmp_path, marked):
    own = events if marked else events[events["event"] != "run_start"]
    own = own[own["tid"] < 2] if marked else own
    delay = 6 * 3600
    got, _ = played(spark, own, tmp_path / "in", lambda s: runs.split_runs(s, ["tid"], marked, 600.0, f"{delay} seconds"), delay)
    want = runlog.split_runs(spark.createDataFrame(own), 600.0, ["tid"]).collect()
    names = ["event_id", "tid", "run"]
    assert len(want) > 100 and max(r["run"] for r in want) > 3
    assert sorted(key(r, names) for r in got if r["stage"] != "closing") == sorted(key(r, names) for r in want)


def test_intervals_of_a_stream(spark, events, tmp_path):
    delay = 6 * 3600
    got, states = played(spark, events, tmp_path / "in", lambda s: runs.intervals(s, ["tid", "stage"], ties=["event_id"], late=f"{delay} seconds"), delay)
    want = runlog.intervals(spark.createDataFrame(events), ["tid", "stage"], ties=["event_id"]).collect()
    names = ["tid", "stage", "k", "t0", "t1", "seconds", "bytes"]
    assert len(want) > 50 and sorted(key(r, names) for r in got) == sorted(key(r, names) for r in want)
    assert states and max(states) < len(events)  # what has passed is kept no more


def test_later_than_the_delay_is_left_out(spark, events, tmp_path):
    late = events.iloc[:1].copy()
    late["event_id"] = 10**6
    got, _ = played(spark, events, tmp_path / "in", lambda s: s.select(*COLUMNS), 60)
    assert len(got) == len(events) + 8
    runs.keyed_state(spark)
    schema = spark.createDataFrame(events).schema
    spark.createDataFrame(late, schema).coalesce(1).write.parquet(f"{tmp_path / 'in'}/z")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    rows = []
    q = runs.split_runs(stream, ["tid"], False, late="60 seconds").writeStream.foreachBatch(lambda df, _: rows.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert rows and all(r["event_id"] != 10**6 for r in rows)


def test_spectra_grow_as_channels_arrive(spark, tables, tmp_path):
    from faradeon.streaming import live_spectra

    samples = queries.cube(spark, tables).join(queries.AXES.channels(spark).select("chan", "lsq"), "chan")
    for k in range(4):
        samples.where(F.col("chan") % 4 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    runs.keyed_state(spark)
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    seen, states = {}, []
    q = live_spectra(stream, queries.RM).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.update({(r["x"], r["y"]): r for r in df.collect()})).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(240)
    states = [o.numRowsTotal for p in q.recentProgress for o in p.stateOperators]
    want = queries.far(spark, tables).collect()
    assert len(seen) == 25 and max(states) == 25
    for r in want:
        got = seen[r["x"], r["y"]]
        assert got["w"] == r["w"] and (r["re"] is None or (got["re"][r["irm"]] == pytest.approx(r["re"], abs=1e-9) and got["im"][r["irm"]] == pytest.approx(r["im"], abs=1e-9)))
