"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows of each source are ranked in a seeded random order; rank / size of the source is a row's place in (0, 1);
rows are sorted by place over all sources and cut into equal runs. Every run then holds every source in
proportion (within one row a source). Both orderings are ranked by uniform buckets: counts by bucket give the
first rank of a bucket, and a window ranks within it, so neither a hot source nor the whole table meets in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialise

SHARDS = 8
SEED = 17
#: Buckets of each ordering; a bucket of a trillion rows' table would hold 250 million rows of it, in as many tasks.
BUCKETS = 4096


def _bits(digits: int, *parts: Column) -> Column:
    """The first hexadecimal digits of the md5 of the joined parts, as a number: a hash that SQL has too. Null parts are left out."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(x.cast("string") for x in parts))), 1, digits), 16, 10).cast("long")


def _before(column: str, *, by: list[Column], order: Column) -> Column:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(w), F.lit(0))


def stratified_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, buckets: int = BUCKETS, stratum: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, source, law ('rows'), shard, slot, grown_shard (null) for every row of ``docs``.

    Sizes of shards differ by one row at most. A null source is a stratum of its own; a null text has size 1 and
    crc 0. Rows are ordered by a seeded hash of doc_id; rows that share a doc_id are ordered by text checksum and
    size, and rows equal in those may exchange their places. An empty table gives an empty result. Other
    columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    key = _bits(15, F.lit(seed), F.col("doc_id").cast("long"))
    # a null source must not meet a source that has the stand-in's name
    strata = F.when(F.col(stratum).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(stratum).cast("string")))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).alias("source"), strata.alias("s"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        key.alias("h"), F.shiftright(F.shiftright(key, 28) * buckets, 32).cast("int").alias("b"),  # buckets follow the order of h
    )
    counts = rows.groupBy("s", "b").agg(F.count("*").alias("n"))
    firsts = counts.select("s", "b", _before("n", by=[F.col("s")], order=F.col("b")).alias("first"), F.sum("n").over(Window.partitionBy("s")).alias("all"))
    own = Window.partitionBy("s", "b").orderBy("h", "doc_id", "text_crc32", "size")
    # each source starts at its own phase, so that many small sources don't meet at the same place
    phase = _bits(5, F.lit(seed), F.col("s")) / F.lit(float(1 << 20))
    place = (F.col("first") + F.col("r") - phase) / F.col("all")
    placed = (
        rows.withColumn("r", F.row_number().over(own)).join(firsts, ["s", "b"]).withColumn("place", place)
        .select("doc_id", "source", "size", "text_crc32", "s", "h", "place", F.least(F.greatest(F.floor(F.col("place") * buckets), F.lit(0)), F.lit(buckets - 1)).cast("int").alias("q"))
    )
    placed = materialise(placed, "shard-places")
    # one row a bucket: `buckets` rows at most meet in the task that sums them
    table = placed.groupBy("q").agg(F.count("*").alias("n")).select("q", _before("n", by=[], order=F.col("q")).alias("first"), F.sum("n").over(Window.partitionBy()).alias("all"))
    position = F.row_number().over(Window.partitionBy("q").orderBy("place", "s", "h", "doc_id", "text_crc32", "size")) - 1
    at = placed.withColumn("p", position).join(F.broadcast(table), "q").withColumn("p", F.col("first") + F.col("p"))  # `buckets` rows at most
    shard = F.floor(F.col("p").cast("decimal(20,0)") * shards / F.col("all")).cast("int")
    # shard k starts at the least position p with floor(p * shards / all) = k
    start = F.ceil(F.col("shard").cast("decimal(20,0)") * F.col("all") / shards).cast("long")
    return at.withColumn("shard", shard).select("doc_id", "size", "text_crc32", "source", F.lit("rows").alias("law"), "shard", (F.col("p") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, assigned: DataFrame, out: str) -> None:
    """Write the rows of ``docs`` (unique doc_id) to ``out``, one folder a shard, files in the order of slots."""
    rows = docs.join(assigned.select("doc_id", "shard", "slot"), "doc_id")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(out)
