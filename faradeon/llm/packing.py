"""Best-fit packing: best-two-fit over the histogram of piece lengths.

A piece's place depends on its length alone, so the packing is planned on counts by length (``capacity`` numbers
at most, whatever the corpus): bins are filled greedily with the longest length that fits; then the bin's
smallest piece is replaced by the two unpacked pieces that fit the expanded gap more tightly. One step plans
all bins that get the same lengths, as many as the counts allow. Pieces then take the planned places by their
rank within their length, which is counted in salted groups, so a length that holds a third of all pieces
is spread over tasks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import bounded_batches, materialise, texts
from .tokenize import encoder, vocabulary

CAPACITY = 1024
END = 2
#: Groups into which the pieces of one length are dealt for ranking.
SALTS = 256

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _cut(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            out = {f.name: [] for f in _PIECES}
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids = memoryview(enc.encode(text) + tail)
                n = len(ids) // 4
                a, b = 0, (n - 1) % capacity + 1
                piece = 0
                while a < n:
                    for k, v in zip(out, (doc_id, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                        out[k].append(v)
                    a, b, piece = b, b + capacity, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _PIECES], schema=_PIECES)

    return run


def cut_pieces(docs: DataFrame, path: str | None = None, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise whole texts (null: empty), append the end id and cut what is longer than ``capacity``.

    All pieces but the first of a document hold ``capacity`` ids; the first holds the rest.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(path or vocabulary(), end, capacity), PIECES)


def _best_two(left: Counter, lengths: list[int], gap: int, least: int) -> tuple[int, int] | None:
    """The two unpacked lengths of the largest sum in (least, gap]; the sum fills the gap best."""
    best, pair, hi = least, None, len(lengths) - 1
    for lo, a in enumerate(lengths):  # ascending; hi walks down, so one pass sees every best partner
        if a > gap // 2:
            break
        while hi > lo and a + lengths[hi] > gap:
            hi -= 1
        if hi > lo and a + lengths[hi] > best:
            best, pair = a + lengths[hi], (a, lengths[hi])
        if left[a] > 1 and best < 2 * a <= gap:
            best, pair = 2 * a, (a, a)
    return pair


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """[(lengths of a bin, number of such bins)] for counts by length (1 to capacity); every piece is placed once."""
    left = Counter({n: c for n, c in counts.items() if c > 0})
    plan: list[tuple[list[int], int]] = []
    while left:
        lengths = sorted(left)
        take: Counter = Counter()
        gap = capacity
        fits = len(lengths)
        while fits:
            n = lengths[fits - 1]
            if n > gap or left[n] - take[n] < 1:
                fits -= 1
                continue
            take[n] += 1
            gap -= n
        if gap and len(take) and sum(take.values()) > 1:
            small = min(take)
            rest = Counter({n: c - take[n] for n, c in left.items() if c > take[n]})
            if pair := _best_two(rest, sorted(rest), gap + small, small):
                take[small] -= 1
                take.update(pair)
                take += Counter()
        bins = min(left[n] // k for n, k in take.items())
        plan.append((sorted(take.elements(), reverse=True), bins))
        for n, k in take.items():
            left[n] -= k * bins
            if not left[n]:
                del left[n]
    return plan


def _places(plan: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first bin, offset), ascending by rank; rank r goes to bin first bin + r - first rank."""
    used, rows, base = Counter(), {}, 0
    for lengths, bins in plan:
        at = 0
        for n in lengths:
            rows.setdefault(n, []).append((used[n], base, at))
            used[n] += bins
            at += n
        base += bins
    return {n: np.array(v, np.int64) for n, v in rows.items()}


def _assign(places: dict[int, np.ndarray], columns: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(k))) for k in ("length", "__rank"))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own, t = length == n, places[int(n)]
                i = np.searchsorted(t[:, 0], rank[own], "right") - 1
                seq[own], off[own] = t[i, 1] + rank[own] - t[i, 0], t[i, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(seq), pa.array(off)], schema=schema)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc_id, piece, start, length, ids_crc32), lengths 1 to capacity.

    ``pieces`` should be a stored table: it is read for the histogram, the salted counts and the places. Rows
    that are equal in all columns may exchange their places. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    bounded_batches(spark)
    # equal rows go to the same salt only if they are the same piece of the same document
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    # bounded: at most `capacity` rows
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    places = _places(plan_bins(histogram, capacity))
    before = counts.select("length", "__salt", F.coalesce(F.sum("__n").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = salted.withColumn("__row", F.row_number().over(own)).join(before, ["length", "__salt"]).withColumn("__rank", F.col("__before") + F.col("__row") - 1)
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema]
    columns = pieces.columns
    schema = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])
    return ranked.select(*columns, "__rank").mapInArrow(_assign(places, columns, schema), ", ".join([*fields, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, path: str | None = None, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack ``docs`` (doc_id, text; other columns are ignored): one row a piece."""
    return pack(materialise(cut_pieces(docs, path, end, capacity), "pieces"), capacity)


def sequences(docs: DataFrame, packed: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """The packed token sequences themselves: sequence_id, ids array<int>, doc_ids, offsets (in order of place).

    Pieces are encoded again where the text is, sent to their sequences and put together there; a sequence
    holds at most its capacity. doc_id must be unique here.
    """
    bounded_batches(docs.sparkSession)
    path, tail = path or vocabulary(), np.array([end], "<u4").tobytes()
    schema = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, places in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(encoder(path).encode(text) + tail, "<u4").astype(np.int32)
                out += [{"sequence_id": p["sequence_id"], "offset": p["offset"], "doc_id": doc_id, "ids": ids[p["start"] : p["start"] + p["length"]]} for p in places]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    own = packed.groupBy("doc_id").agg(F.collect_list(F.struct("sequence_id", "offset", "start", "length")).alias("places"))
    parts = docs.select("doc_id", "text").join(own, "doc_id").select("doc_id", "text", "places").mapInArrow(run, "sequence_id long, offset long, doc_id long, ids array<int>")
    whole = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return whole.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))
