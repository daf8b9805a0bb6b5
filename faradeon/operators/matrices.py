"""Matrices as rows (by, i, j, v; i and j from 0): products by blocks, transposes, inverses. What isn't there is 0."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and columns of a block, and the largest matrix that a task inverts.
BLOCK, SIDE = 64, 1024


def _dense(rows: DataFrame, keys: list[str], place: Column, size: int) -> DataFrame:
    """keys and _block: an array of ``size`` numbers by place."""
    held = rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(place.cast("int"), F.col("v").cast("double")))).alias("_m"))
    return held.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0.0))).alias("_block"))


def _blocks(df: DataFrame, by: list[str], block: int, names: tuple[str, str]) -> DataFrame:
    """by, block row, block column, _block: dense blocks; an entry that comes twice counts as the sum."""
    one = df.groupBy(*by, "i", "j").agg(F.sum("v").alias("v"))
    cut = one.select(*by, F.floor(F.col("i") / block).alias(names[0]), F.floor(F.col("j") / block).alias(names[1]), (F.col("i") % block * block + F.col("j") % block).alias("_p"), "v")
    return _dense(cut, [*by, *names], F.col("_p"), block * block)


def _cube(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, n, n)


def product(a: DataFrame, b: DataFrame, by: list[str] = (), block: int = BLOCK) -> DataFrame:
    """by, i, j, v of a times b, entries that aren't 0: blocks meet in a join on the inner index, and sums of their products combine before the shuffle."""
    by = list(by)
    left, right = _blocks(a, by, block, ("_i", "_k")), _blocks(b, by, block, ("_k", "_j")).withColumnRenamed("_block", "_other")
    n_by = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = (_cube(batch.column(n_by + 2), block) @ _cube(batch.column(n_by + 3), block)).reshape(-1)
                lists = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * block * block, pa.array(out))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n_by + 2)), lists], names=[*by, "_i", "_j", "_block"])

    met = left.join(right, [*by, "_k"]).select(*by, "_i", "_j", "_block", "_other")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.select(*by, "_i", "_j").schema)
    parts = met.mapInArrow(run, f"{kinds}, _block array<double>").select(*by, "_i", "_j", F.posexplode("_block").alias("_p", "v")).where("v <> 0")
    place = lambda own, at: (F.col(own) * block + at).cast("int")
    return parts.select(*by, place("_i", F.floor(F.col("_p") / block)).alias("i"), place("_j", F.col("_p") % block).alias("j"), "v").groupBy(*by, "i", "j").agg(F.sum("v").alias("v"))


def transposed(df: DataFrame) -> DataFrame:
    return df.withColumns({"i": F.col("j"), "j": F.col("i")})


def inverse(df: DataFrame, n: int, by: list[str] = ()) -> DataFrame:
    """by, i, j, v of each inverse of n by n matrices; one that is singular has no rows. Many matrices are inverted at once,
    each within a task, so ``n`` is SIDE at most."""
    if n > SIDE:
        raise ValueError(f"a task holds matrices of {SIDE} rows at most")
    by = list(by)
    whole = _dense(df.groupBy(*by, "i", "j").agg(F.sum("v").alias("v")).withColumn("_p", F.col("i") * n + F.col("j")), by, F.col("_p"), n * n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _cube(batch.column(len(by)), n)
            scale = np.abs(m).max((1, 2), initial=0)
            ok = (scale > 0) & np.isfinite(scale)
            ok[ok] = np.linalg.cond(m[ok] / scale[ok, None, None]) < 1e15
            at = pa.array(np.flatnonzero(ok))
            out = np.linalg.inv(m[ok]).reshape(-1)
            lists = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * n * n, pa.array(out))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(by))), lists], names=[*by, "_block"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.select(*by).schema)
    rows = whole.mapInArrow(run, f"{kinds}{', ' if by else ''}_block array<double>").select(*by, F.posexplode("_block").alias("_p", "v"))
    return rows.select(*by, F.floor(F.col("_p") / n).cast("int").alias("i"), (F.col("_p") % n).cast("int").alias("j"), "v")
