"""Run logs: events, runs, intervals, overlaps and stage totals, as regular expressions, windows and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scan import running

#: Words of log messages, as FIXTURES.md (F8) has them; fixed values.
BOUNDED, STEPS, QUEUED, TIMED, DEVICE, STARTED = ("start", "done"), ("prep", "send", "start", "done"), "async", "thread_timing", "gpu", "run started"

#: Seconds of a log that one task orders.
RANGE_SECONDS = 3600


def _first(words: Column, test) -> Column:
    """The first word that passes; null if none does."""
    return F.get(F.filter(words, test), F.lit(0))


def _value(words: Column, key: str, kind: str = "string") -> Column:
    """What stands after ``key=``."""
    return F.substring_index(_first(words, lambda w: F.startswith(w, F.lit(f"{key}="))), "=", -1).try_cast(kind)


def _bounds(words: Column, key: str) -> Column:
    """[first, last] of a word like ``key:[first,last]``."""
    return F.split(F.translate(F.substring_index(_first(words, lambda w: F.startswith(w, F.lit(f"{key}:["))), ":[", -1), "]", ""), ",")


def parse(lines: DataFrame) -> DataFrame:
    """Typed events of text rows (value); lines of another form are left out. Works on streams too.

    A line is a time, three bracketed fields (level, stage, tid=number) and a message; a message is words, key=value
    pairs and ranges like y:[first,last], which are looked up by key wherever they stand.
    """
    fields = F.regexp_extract_all("value", F.lit(r"\[([^\[\]]*)\]"), 1)
    tid = F.get("_f", F.lit(2))
    time = F.substring_index("value", " ", 1)
    lined = lines.select("value", fields.alias("_f")).where((F.size("_f") >= 3) & F.startswith(tid, F.lit("tid=")))
    after = F.expr("locate(concat('[', get(_f, 2), ']'), value) + length(get(_f, 2)) + 2")
    parts = lined.select(
        F.when(time.rlike(r"^[0-9-]{10}T[0-9:]{8}\.[0-9]{3}$"), F.try_to_timestamp(time, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS"))).cast("timestamp_ntz").alias("ts"), F.get("_f", F.lit(0)).alias("level"), F.get("_f", F.lit(1)).alias("stage"),
        F.substring_index(tid, "=", -1).try_cast("int").alias("tid"), F.ltrim(F.substr("value", after)).alias("msg"),
    ).where("ts is not null and tid is not null")
    known = parts.withColumn("_w", F.filter(F.split("msg", r"\s+"), lambda w: w != "")).withColumn("_p", F.filter("_w", lambda w: ~F.contains(w, F.lit("=")) & ~F.contains(w, F.lit(":["))))
    w, plain = F.col("_w"), lambda k: F.get("_p", F.lit(k))
    part = F.split(_first(F.col("_p"), lambda x: x.rlike("^[0-9]+/[0-9]+$")), "/")
    queued, device = plain(0) == QUEUED, (plain(0) == DEVICE) & plain(1).isin("send", "recv")
    event = (
        F.when(queued, plain(1)).when(plain(0) == TIMED, _value(w, "event")).when(device, F.concat_ws("_", plain(0), plain(1))).when(F.contains("msg", F.lit(STARTED)), "run_start")
        .when(part.isNotNull(), _first(F.col("_p"), lambda x: x.isin(*STEPS))).when(_bounds(w, "x").isNotNull() & _bounds(w, "y").isNotNull(), _first(F.col("_p"), lambda x: x.isin(*BOUNDED)))
    )
    bound = lambda key, k, name: F.get(_bounds(w, key), F.lit(k)).try_cast("int").alias(name)
    sub = F.when(queued, _value(w, "sub", "int")).when(part.isNotNull(), F.get(part, F.lit(0)).try_cast("int")).otherwise(_value(w, "rm_block", "int"))
    return known.select(
        "ts", "level", "stage", "tid", event.alias("event"), bound("x", 0, "x_beg"), bound("x", 1, "x_end"), bound("y", 0, "y_beg"), bound("y", 1, "y_end"), _value(w, "bytes", "long").alias("bytes"),
        F.when(queued, plain(2)).alias("async_stage"), F.when(queued, _value(w, "slot", "int")).alias("slot"), sub.alias("sub"), "msg",
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def split_runs(events: DataFrame, gap_seconds: float = 300.0, by: list[str] = (), range_seconds: int = RANGE_SECONDS) -> DataFrame:
    """Add ``run`` (from 0): a log with start markers begins a run at each, one without after every longer gap.

    ``by`` names the logs (files) that are split apart. Events are ordered within time ranges; the last time and
    the number of runs before a range come from tables of one row a log and range.
    """
    keys = [*by, "_range"]
    log, own = Window.partitionBy(*by), Window.partitionBy(*keys).orderBy("ts")
    before = log.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    marked = events.withColumn("_mark", (F.coalesce("event", F.lit("")) == "run_start").cast("int")).withColumn("_range", F.floor(_micros("ts") / (range_seconds * 1_000_000)))
    ranges = marked.groupBy(*keys).agg(F.max("_mark").alias("_m"), F.max("ts").alias("_last"))
    known = _beside(marked, ranges.select(*keys, F.max("_m").over(log).alias("_any"), F.max("_last").over(before).alias("_before")), keys)
    gap = (_micros("ts") - _micros(F.coalesce(F.lag("ts").over(own), "_before"))) > gap_seconds * 1_000_000
    cut = known.withColumn("_cut", F.when(F.col("_any") == 1, F.col("_mark")).otherwise(F.coalesce(gap, F.lit(False)).cast("int")))
    cuts = cut.groupBy(*keys).agg(F.sum("_cut").alias("_c")).select(*keys, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_earlier"))
    run = F.col("_earlier") + F.sum("_cut").over(own.rangeBetween(Window.unboundedPreceding, 0)) - F.col("_any")
    # what comes before the first marker belongs to no run
    return _beside(cut, cuts, keys).withColumn("run", run).where("run >= 0").select(*events.columns, F.col("run").cast("int").alias("run"))


def _micros(time: str | Column) -> Column:
    return F.unix_micros((F.col(time) if isinstance(time, str) else time).cast("timestamp"))


def _beside(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of the row of ``ranges`` that has the same keys; nulls are equal."""
    other = ranges.select(*(F.col(c).alias(f"_k_{c}" if c in keys else c) for c in ranges.columns))
    return rows.join(other, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]).drop(*(f"_k_{k}" for k in keys))


def select_run(events: DataFrame, which: str | int) -> DataFrame:
    """Events of one run: 'first', 'latest', or a number; negative numbers count from the end."""
    if which == "first":
        which = 0
    if which == "latest":
        which = -1
    order = F.col("run") if int(which) >= 0 else F.col("run").desc()
    rank = F.dense_rank().over(Window.orderBy(order))
    runs = events.select("run").distinct().withColumn("_r", rank).where(F.col("_r") == (int(which) + 1 if int(which) >= 0 else -int(which))).select("run")
    return events.join(F.broadcast(runs), "run", "left_semi")  # one row


def intervals(events: DataFrame, by: list[str] = ("run", "stage"), start: str = "start", end: str = "done", ties: list[str] = ("bytes",), range_seconds: int = RANGE_SECONDS) -> DataFrame:
    """The k-th start with the k-th end of each group, where the end is later: by, k, t0, t1, seconds, bytes.

    Events of one time are ordered by ``ties``. Ranks are counted by time ranges, so a long log is many tasks.
    """
    some = events.where(F.col("event").isin(start, end)).withColumn("_one", F.lit(1).cast("long"))
    numbered = _running(some, [*by, "event"], F.unix_micros(F.col("ts").cast("timestamp")), ["ts", *ties], {"k": "_one"}, range_seconds)
    # one event of each kind has a number, so both meet in a grouping, which moves each row once
    of = lambda kind, c: F.max(F.when(F.col("event") == kind, F.col(c)))
    paired = numbered.groupBy(*by, "k").agg(of(start, "ts").alias("t0"), of(end, "ts").alias("t1"), of(start, "bytes").alias("b0"), of(end, "bytes").alias("b1"))
    seconds = F.unix_micros(F.col("t1").cast("timestamp")) / 1e6 - F.unix_micros(F.col("t0").cast("timestamp")) / 1e6
    return paired.where("t1 > t0").select(*by, "k", "t0", "t1", F.round(seconds, 6).alias("seconds"), F.coalesce("b0", "b1").alias("bytes"))


def stage_totals(spans: DataFrame, by: list[str] = ("run", "stage")) -> DataFrame:
    """Seconds, bytes and MB/s by stage, largest first."""
    out = spans.groupBy(*by).agg(F.sum("seconds").alias("seconds"), F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    return out.withColumn("mb_per_s", F.col("bytes") / 1e6 / F.greatest("seconds", F.lit(1e-6))).orderBy(F.desc("seconds"))


def _sweep(spans: DataFrame, by: list[str], extra: list[Column]) -> DataFrame:
    one = lambda t, d: F.struct(F.unix_micros(F.col(t).cast("timestamp")).alias("t"), F.lit(d).alias("d"))
    return spans.select(*by, *extra, F.explode(F.array(one("t0", 1), one("t1", -1))).alias("p")).select(*by, *[c for c in spans.columns if c == "_tag"], "p.t", "p.d")


def _running(rows: DataFrame, by: list[str], micros: Column, order: list, sums: dict[str, str], range_seconds: int) -> DataFrame:
    """``scan.running`` over time ranges of so many seconds."""
    return running(rows, by, F.floor(micros / (range_seconds * 1_000_000)), order, sums)


def _levels(points: DataFrame, by: list[str], steps: list[str], order: list, range_seconds: int) -> DataFrame:
    """by, us (microseconds), and for each of ``steps`` (columns of +1, -1 or 0) how many are open then; one row a time range and level.

    Within a time range one window gives each point's level, counted from the range's start, and the time to the next
    point, which is summed by level in place. What meets by group is a row a range, however many levels it has: it gives
    the counts at a range's start and the time from its last point to the next range's first, which its last level takes.
    """
    at = points.withColumn("_key", F.struct(*by, F.floor(F.col("t") / (range_seconds * 1_000_000)).alias("_range")))
    own = Window.partitionBy("_key").orderBy(*order)
    local = at.select("_key", (F.lead("t").over(own) - F.col("t")).alias("_to"), *(F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_l{c}") for c in steps))
    level = local.groupBy("_key", *(f"_l{c}" for c in steps)).agg(F.sum("_to").alias("_to"))
    groups = [F.col("_key").getField(c) for c in by]
    group = Window.partitionBy(*groups).orderBy(F.col("_key._range"))
    # frames grow from the group's start: Spark adds up one that shrinks to the group's end anew for every row
    before = group.rowsBetween(Window.unboundedPreceding, -1)
    ranges = at.groupBy("_key").agg(F.min("t").alias("_first"), F.max("t").alias("_last"), *(F.sum(c).alias(f"_t{c}") for c in steps))
    ranges = ranges.select("_key", (F.lead("_first").over(group) - F.col("_last")).alias("_gap"), *(f"_t{c}" for c in steps), *(F.coalesce(F.sum(f"_t{c}").over(before), F.lit(0)).alias(f"_b{c}") for c in steps))
    last = F.struct(*(F.col(f"_l{c}") for c in steps)) == F.struct(*(F.col(f"_t{c}").alias(f"_l{c}") for c in steps))
    us = F.coalesce("_to", F.lit(0)) + F.when(last, F.coalesce("_gap", F.lit(0))).otherwise(0)
    return level.join(ranges, "_key").select(*(g.alias(c) for g, c in zip(groups, by, strict=True)), us.alias("us"), *((F.col(f"_b{c}") + F.col(f"_l{c}")).alias(c) for c in steps))


def _seconds(rows: DataFrame, by: list[str], where: Column) -> DataFrame:
    """by, seconds of ``_levels`` that pass; microseconds are added as integers, so no order of adding shows."""
    return rows.groupBy(*by).agg((F.coalesce(F.sum(F.when(where, F.col("us"))), F.lit(0)) / 1e6).alias("seconds"))


def active_counts(spans: DataFrame, by: list[str] = ("run",), range_seconds: int = RANGE_SECONDS) -> DataFrame:
    """by, t (microseconds), d, active: how many spans are open after each start or end."""
    points = _sweep(spans, list(by), [])
    return _running(points, list(by), F.col("t"), ["t", F.desc("d")], {"active": "d"}, range_seconds).select(*by, "t", "d", "active")


def self_overlap(spans: DataFrame, by: list[str] = ("run",), range_seconds: int = RANGE_SECONDS) -> DataFrame:
    """Seconds during which two spans or more are open."""
    rows = _levels(_sweep(spans, list(by), []), list(by), ["d"], ["t", F.desc("d")], range_seconds)
    return _seconds(rows, list(by), F.col("d") >= 2)


def cross_overlap(spans: DataFrame, kind: str, a: str, b: str, by: list[str] = ("run",), range_seconds: int = RANGE_SECONDS) -> DataFrame:
    """Seconds during which a span of kind ``a`` and one of kind ``b`` are open."""
    tagged = spans.where(F.col(kind).isin(a, b)).withColumn("_tag", F.col(kind))
    points = _sweep(tagged, list(by), [F.col("_tag")])
    step = lambda k: F.when(F.col("_tag") == k, F.col("d")).otherwise(0)
    rows = _levels(points.withColumn("na", step(a)).withColumn("nb", step(b)), list(by), ["na", "nb"], ["t", F.desc("d"), "_tag"], range_seconds)
    return _seconds(rows, list(by), (F.col("na") > 0) & (F.col("nb") > 0))


def macro_timing(stages: DataFrame, total: str = "total") -> DataFrame:
    """stage, seconds, percent of the total, and a row 'other' for what no stage has (0 at least). ``stages``: stage, seconds."""
    t = stages.agg(F.max(F.when(F.col("stage") == total, F.col("seconds"))).alias("t"), F.coalesce(F.sum(F.when(F.col("stage") != total, F.col("seconds"))), F.lit(0.0)).alias("s"))
    other = t.select(F.lit("other").alias("stage"), F.greatest(F.col("t") - F.col("s"), F.lit(0.0)).alias("seconds"))
    return stages.select("stage", "seconds").unionByName(other).crossJoin(F.broadcast(t.select("t"))).select("stage", "seconds", (100 * F.col("seconds") / F.nullif("t", F.lit(0.0))).alias("percent"))


def speed_up(runs: DataFrame, by: list[str] = ()) -> DataFrame:
    """Add ``speedup``: elapsed of the 1-thread run, else of the run with fewest threads, over a run's own. ``runs``: threads, elapsed."""
    base = F.first("elapsed").over(Window.partitionBy(*by).orderBy((F.col("threads") != 1).cast("int"), "threads").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return runs.withColumn("speedup", base / F.nullif("elapsed", F.lit(0.0)))
