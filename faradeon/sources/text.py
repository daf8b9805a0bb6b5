"""Text inputs and outputs: lists of bad channels, column files, axis dumps, timing records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of a timing record and their types; fixed values.
TIMING = (
    "run_id string, mode string, cube_nx int, cube_ny int, cube_nchan int, cube_nrm int, tile_ra int, tile_dec int, stage_total_sec double, cfg_parse_sec double, io_init_sec double, header_sec double, "
    "tile_total_sec double, tile_read_sec double, tile_mask_sec double, tile_prep_sec double, tile_compute_sec double, tile_scatter_sec double, tile_cubestat_sec double, tile_write_sec double, finalize_sec double, "
    "io_read_bytes long, io_write_bytes long, io_read_syscalls long, io_write_syscalls long, io_read_init_sec double, io_write_init_sec double"
)


def bad_channels(spark: SparkSession, path: str, n_chan: int) -> list[int]:
    """Channels (from 1) of a list, one number a line, cut to whole numbers. A missing file gives none; a list as long
    as the axis is an error."""
    try:
        rows = spark.read.text(path).select(F.expr("int(try_cast(trim(value) AS double))").alias("c")).where("c is not null").limit(n_chan).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    if len(rows) >= n_chan:
        raise ValueError("the list of bad channels is as long as the axis")
    return [r["c"] for r in rows]


def column(spark: SparkSession, path: str, place: int) -> DataFrame:
    """line (from 0, without gaps over all partitions), value of one column (from 1) of a file of columns divided by white space.

    A line whose column is no number (a header, a comment) is left out; nan and inf are numbers.
    """
    value = F.try_element_at(F.split(F.trim("value"), r"\s+"), F.lit(place))
    rows = spark.read.text(path).select(value.alias("v")).selectExpr("try_cast(v AS double) AS value")
    rows = rows.where("value is not null").withColumn("__at", F.monotonically_increasing_id())
    # places in two steps: rows before a partition, then within it; the first has one row a partition
    part = F.shiftright("__at", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return rows.withColumn("__part", part).join(before, "__part").select((F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy("__at")) - 1).alias("line"), "value")


def write_axis(values: DataFrame, path: str) -> None:
    """One number a line."""
    values.coalesce(1).selectExpr(f"string({values.columns[0]}) value").write.text(path)


def timing_record(spark: SparkSession, known: dict) -> DataFrame:
    """One row of TIMING; what isn't known is 0."""
    kinds = dict(c.split() for c in TIMING.split(", "))
    empty = {"string": "", "int": 0, "long": 0, "double": 0.0}
    return spark.createDataFrame([tuple(known.get(k, empty[t]) for k, t in kinds.items())], TIMING)


def append_timing(record: DataFrame, path: str) -> None:
    record.select(*(c.split()[0] for c in TIMING.split(", "))).write.mode("append").option("header", True).csv(path)


def read_timing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TIMING).option("header", True).csv(path)


def export_long(df: DataFrame, path: str, sep: str = " ") -> None:
    """Long-form rows as text columns."""
    df.write.option("sep", sep).option("header", True).csv(path)
