"""Helpers that the training-data operators share: the shared folder, materialised tables, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch handed to a Python worker; bounds a worker's memory whatever the texts' lengths.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000
#: Parquet's options for tables with rows of megabytes. By default it looks at the size of a page and of a row group
#: after 100 rows only, and holds, compresses and decodes them whole.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset and the master is local (as in
    tests), where driver and executors are one process, a temporary folder serves.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/faradeon-shared"


def own_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/faradeon-{label}-{uuid.uuid4().hex}"


def temporary(spark: SparkSession, path: str) -> None:
    """Delete what was written to ``path`` when the driver's JVM ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def materialise(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet, with its ``options``, into the shared folder and read it again.

    This cuts the lineage (a lost executor costs only the tasks that read the table) and keeps costly steps
    from running twice. The table is deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = own_path(spark, label)
    df.write.options(**(options or {})).parquet(path)
    temporary(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session in bytes and rows, unless it already asks for fewer."""
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{key}"
        now = str(spark.conf.get(key)).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


@contextmanager
def small_splits(spark: SparkSession, most: int) -> Iterator[None]:
    """Queries run inside read at most so many bytes of files in a task; the session's own setting, if less, holds, and comes back."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) > most:
        spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def texts(column: pa.Array) -> list[str]:
    """Python strings of a text column; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def chunks(table: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One record batch of named columns, or none if there are no rows."""
    batch = pa.RecordBatch.from_arrays([pa.array(table[f.name], f.type) for f in schema], schema=schema)
    if batch.num_rows:
        yield batch


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, column: str = "doc_id") -> DataFrame:
    """``__id`` as in with_key, and ``__row``: all columns in a struct, so that none meets a name of an operator's own."""
    return df.select(F.coalesce(F.col(column).cast("long"), F.lit(-(2**63))).alias("__id"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"))


def with_key(df: DataFrame, column: str) -> DataFrame:
    """``__id``: the column as long, null as the least long, so that null rows join and sort like any other."""
    return df.withColumn("__id", F.coalesce(F.col(column).cast("long"), F.lit(-(2**63))))
