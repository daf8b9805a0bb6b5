"""Cubes as Parquet by strips of the sky.

A strip is ``rows`` rows of the sky, named by its first row: folders ``rows=R/y0=Y``. Within a file pixels are sorted by
y and x, so that Parquet's statistics tell which row groups hold a range of rows. Reading a range of the sky opens the
folders that can hold it and no others, and of their files the row groups that can.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the sky in a strip, and pixels in a row group, unless the caller knows better.
ROWS, GROUP_BYTES = 16, 16 << 20


def write_strips(df: DataFrame, path: str, rows: int = ROWS, mode: str = "errorifexists", dealt: bool = False) -> None:
    """Write pixels (x, y, and any other columns) by strips of ``rows`` rows of the sky.

    Strips are dealt out by ranges, so each is in one file, or in a few if it is large. ``dealt``: the rows come by
    strips already, as from the FITS readers, and stay in their partitions without a shuffle. Rows may repeat; a null y is an error of the caller's that
    shows as a strip of its own. A failed job leaves no finished folder: Spark's commit holds for all files together.
    """
    if rows < 1:
        raise ValueError("a strip has a row at least")
    named = df.withColumn("y0", (F.floor((F.col("y") - 1) / rows) * rows + 1).cast("int"))
    if not dealt:
        named = named.repartitionByRange("y0", "y", "x")
    named.sortWithinPartitions("y0", "y", "x").withColumn("rows", F.lit(rows)).write.mode(mode).option("parquet.block.size", GROUP_BYTES).partitionBy("rows", "y0").parquet(path)


def read_strips(spark: SparkSession, path: str, x: tuple[int, int] | None = None, y: tuple[int, int] | None = None) -> DataFrame:
    """Pixels with x and y in [first, last], all by default; only strips and row groups that can hold them are read."""
    df = spark.read.parquet(path)
    if y is not None:
        # on folder names alone, which prunes folders; then on the column, which prunes row groups
        df = df.where((F.col("y0") <= y[1]) & (F.col("y0") + F.col("rows") > y[0])).where(F.col("y").between(*y))
    if x is not None:
        df = df.where(F.col("x").between(*x))
    return df.drop("rows", "y0")
