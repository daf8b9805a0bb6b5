"""Token-ID output: concatenated ids with Elias-Fano document boundaries.

Format: a Parquet table of segments. A segment holds consecutive documents (ascending doc_id):

- ``part`` int, ``seg`` int: order of the segments; ``n_docs``, ``n_tokens``: its documents and ids
- ``ids`` binary: all ids, ``id_bytes`` (2 or 4) bytes each, little-endian
- ``doc_ids`` binary: the documents' ids as little-endian signed 64-bit integers; ``nulls`` binary: one bit each
- ``ef_top``, ``ef_width``, ``ef_low``, ``ef_high``, ``ef_samples``: Elias-Fano code of the ``n_docs`` ends of
  the documents in the segment; the end of document i is the start of document i + 1

Segments close at ``SEGMENT_TOKENS`` ids, so neither a task nor a row grows with the corpus. Two passes over
the data: one range shuffle of the texts, whose tasks encode and write; one read of the files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import bounded_batches, own_path, temporary, texts
from .elias_fano import EliasFano
from .tokenize import encoder, vocabulary

SEGMENT_TOKENS = 2_000_000
END = 2
#: Characters of a text that tell where rows of one doc_id may be split.
HEAD = 32

SEGMENTS = "part int, seg int, n_docs long, n_tokens long, id_bytes int, ids binary, doc_ids binary, nulls binary, ef_top long, ef_width int, ef_low binary, ef_high binary, ef_samples binary"
ROWS = "part int, seg int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def _segment(part: int, seg: int, ids: list[bytes], doc_ids: list[int | None]) -> dict:
    ends = np.cumsum([len(x) // 4 for x in ids])
    flat = np.frombuffer(b"".join(ids), "<u4")
    narrow = not len(flat) or int(flat.max()) < 1 << 16
    ef = EliasFano.encode(ends)
    return {
        "part": part, "seg": seg, "n_docs": len(ids), "n_tokens": int(len(flat)), "id_bytes": 2 if narrow else 4,
        "ids": flat.astype("<u2").tobytes() if narrow else flat.tobytes(),
        "doc_ids": np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes(),
        "nulls": np.packbits([x is None for x in doc_ids], bitorder="little").tobytes(),
        "ef_top": ef.top, "ef_width": ef.width, "ef_low": ef.low, "ef_high": ef.high, "ef_samples": ef.samples,
    }


def _encode(path: str, end: int, segment_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(path), np.array([end], "<u4").tobytes()
        part, seg, held, ids, docs = TaskContext.get().partitionId(), 0, 0, [], []

        def flush():
            return pa.RecordBatch.from_pylist([_segment(part, seg, ids, docs)], schema=_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids.append(enc.encode(text) + tail)
                docs.append(doc_id)
                held += len(ids[-1]) // 4
                if held >= segment_tokens:
                    yield flush()
                    seg, held, ids, docs = seg + 1, 0, [], []
        if ids:
            yield flush()

    return run


_ARROW = pa.schema(
    [("part", pa.int32()), ("seg", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("id_bytes", pa.int32()), ("ids", pa.binary()), ("doc_ids", pa.binary()), ("nulls", pa.binary())]
    + [("ef_top", pa.int64()), ("ef_width", pa.int32()), ("ef_low", pa.binary()), ("ef_high", pa.binary()), ("ef_samples", pa.binary())]
)
_OUT = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_tokens(docs: DataFrame, out: str, path: str | None = None, end: int = END, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode ``docs`` (doc_id, text; other columns are ignored) in ascending doc_id and write the segments to ``out``.

    Null text is empty: the document is the end id alone. Null doc_ids come first. Rows that share a doc_id stay
    together, in the order of their texts. An empty table gives no segments.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the text's beginning splits rows that share a doc_id, or have none, over tasks in the order of their texts
    ordered = rows.repartitionByRange("doc_id", F.substring("text", 1, HEAD)).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_encode(path or vocabulary(), end, segment_tokens), SEGMENTS).write.option("compression", "zstd").parquet(out)


def segment_ids(row: dict) -> np.ndarray:
    """All ids of a segment row."""
    return np.frombuffer(row["ids"], "<u2" if row["id_bytes"] == 2 else "<u4").astype("<u4")


def segment_bounds(row: dict) -> EliasFano:
    """The Elias-Fano ends of a segment row's documents."""
    return EliasFano(row["n_docs"], row["ef_top"], row["ef_width"], row["ef_low"], row["ef_high"], row["ef_samples"])


def document(row: dict, i: int) -> np.ndarray:
    """Ids of document ``i`` of a segment row, found by two selects."""
    ends = segment_bounds(row)
    return segment_ids(row)[ends.select(i - 1) if i else 0 : ends.select(i)]


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            n = row["n_docs"]
            flat, ends = segment_ids(row), segment_bounds(row).selects(np.arange(n))
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            null = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), bitorder="little")[: row["n_docs"]].astype(bool)
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["seg"], np.int32)), pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=null), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())],
                schema=_OUT,
            )


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32: from the files at ``out`` alone.

    Starts are the segments' places, summed in two steps (parts, then segments within a part), plus the
    document's place in its segment. The table of segments is broadcast only while it is small by its measured
    size (Spark's own limit); otherwise it joins by shuffle.
    """
    bounded_batches(spark)
    table = spark.read.parquet(out)
    sizes = table.select("part", "seg", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a task of the writing stage: the only rows that meet in one task
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("part_start"))
    segs = sizes.select("part", "seg", before(Window.partitionBy("part").orderBy("seg")).alias("seg_start"))
    places = segs.join(parts, "part").select("part", "seg", (F.col("part_start") + F.col("seg_start")).alias("base"))
    rows = table.mapInArrow(_decode, ROWS)
    return rows.join(places, ["part", "seg"]).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: ``docs`` written to the shared folder in the format above and read back.

    Nulls, repeats, ties and empty tables: as in write_tokens. Offsets come from the select structures of the files,
    which are deleted when the driver's JVM ends; keep them by write_tokens.
    """
    spark = docs.sparkSession
    out = own_path(spark, "tokens")
    write_tokens(docs, out, path, end)
    temporary(spark, out)
    return read_tokens(spark, out)
