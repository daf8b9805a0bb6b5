"""Exact top-k by inner product: norm-bucketed retrieval with local pruning.

Candidates are grouped by length (Euclidean norm, geometric buckets), buckets are cut into blocks. A first pass
scores each query against the longest vectors and so bounds its k-th best score from below (theta). A query
skips every bucket whose longest vector can't reach theta. Within a block the bound becomes a local cosine
threshold t = theta / (|q| * longest): where t is high, candidates are narrowed by the feasible range of one
focus coordinate; elsewhere by length alone, many queries at once as a matrix product. What is left is
verified by exact integer products, so pruning never changes a result. Vectors with components beyond 2^24 after
scaling form a bucket of their own that every query meets; their products are made of integers of any size.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import bounded_batches, materialise

K = 20
EVERY = 20
SCALE = 64
#: Rows of a candidate block and of a query block; they bound a task's memory, not the result.
BLOCK = 16384
QUERY_BLOCK = 1024
#: Longest vectors that every query is scored against first.
SEEDS = 2048
#: Local cosine threshold from which the coordinate index is tried.
COORDINATE_FROM = 0.6
#: Bucket of a squared norm: two buckets an octave of it; a long has 128 at most. The last one is that of wide vectors.
BUCKETS = 128
WIDE = BUCKETS - 1
#: Vectors with a component beyond this are wide: products of two others stay within 64 bits, up to 2^14 components.
LARGEST = 1 << 24


def bucket_of(norm2):
    """Bucket of squared norms (NumPy); longer vectors have larger buckets."""
    return np.minimum(np.floor(2 * np.log2(np.asarray(norm2, np.float64) + 1)), WIDE - 1).astype(np.int64)


def integer_vectors(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v array<long> (floor(scale * x)), norm2, and x array<double>, for rows whose vectors are whole and finite.

    Wide vectors have their components ``x``, and null in v and norm2; others have null in x. Null ids, null vectors
    and vectors with null or non-finite components take no part. Rows that share a vec_id are rows of their own.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    whole = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: F.coalesce(bad(x.cast("double")), F.lit(True))))
    x = F.transform("embedding", lambda x: x.cast("double"))
    wide = F.exists("x", lambda x: F.abs(x) * scale > LARGEST - 1) | (F.size("x") > 1 << 14)
    rows = whole.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).withColumn("wide", wide)
    ints = rows.withColumn("v", F.when(~F.col("wide"), F.transform("x", lambda x: F.floor(x * scale).cast("long"))))
    return ints.select("vec_id", "v", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x).alias("norm2"), F.when(F.col("wide"), F.col("x")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array<long> column; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n, off = len(column), np.asarray(column.offsets)
    flat, width = np.asarray(column.values)[off[0] : off[-1]], np.diff(off)
    if n and (width == width[0]).all():
        return flat.reshape(n, -1)
    out = np.zeros((n, int(width.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < width[:, None]] = flat
    return out


def _floats(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of an array<double> column; shorter ones end in zeros."""
    rows = column.to_pylist()
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for at, x in zip(out, rows, strict=True):
        at[: len(x)] = x
    return out


def _pack(m: np.ndarray) -> tuple[str, bytes]:
    """Kind of number and bytes; floats are those of wide vectors."""
    if m.dtype == np.float64:
        return "<f8", m.astype("<f8").tobytes()
    kind = "<i2" if int(np.abs(m).max(initial=0)) < 1 << 15 else "<i4"
    return kind, m.astype(kind).tobytes()


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as Python integers of any size; doubles of 2^53 or more are whole numbers themselves."""
    return np.frompyfunc(lambda v: math.floor(v * scale) if abs(v) < 1 << 53 else int(v) * scale, 1, 1)(x)


def _unpack(row: dict, side: str, scale: int) -> np.ndarray:
    n, kind = len(row[f"{side}_rows"]) // 8, row[f"{side}_kind"]
    m = np.frombuffer(row[f"{side}_m"], kind).reshape(n, -1)
    return integers(m, scale) if kind == "<f8" else m.astype(np.int64)


def whole_scores(q: np.ndarray, q_rows: np.ndarray, c: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """(place of the query, ids, scores) where a side is wide: each query's k best of a block by integers of any size."""
    d = min(q.shape[1], c.shape[1])
    q, c = q[:, :d].astype(object), c[:, :d].astype(object)
    for i in range(len(q)):
        scores = c @ q[i] if d else np.zeros(len(c), object)
        top = heapq.nsmallest(k, np.flatnonzero(c_rows != q_rows[i]).tolist(), key=lambda j: (-scores[j], c_ids[j]))
        yield i, c_ids[top], [int(scores[j]) for j in top]


def order_of(score: int) -> tuple[int, int, bytes]:
    """(level, score within 64 bits, tail) that sort as the scores do; scores beyond 64 bits show the nearest long."""
    if -(1 << 63) <= score < 1 << 63:
        return 0, score, b""
    n = abs(score).bit_length()
    tail = abs(score).to_bytes(-(-n // 8), "big")
    return (n, (1 << 63) - 1, tail) if score > 0 else (-n, -(1 << 63), bytes(255 - x for x in tail))


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products; by floating point only where every sum is below 2^53."""
    d = min(q.shape[1], c.shape[1])
    q, c = q[:, :d], c[:, :d]
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * d < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _thetas(seeds: np.ndarray, seed_rows: np.ndarray, k: int):
    """Adds to each query the k-th best score among the seeds and the least bucket that can reach it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, rows = _matrix(batch.column(1)), np.asarray(batch.column(0))
            s = products(q, seeds) if len(seeds) and len(q) else np.zeros((len(q), 0), np.int64)
            norm = np.sqrt(np.asarray(batch.column(2), np.float64))
            theta, least = np.full(len(q), -(2**62), np.int64), np.zeros(len(q), np.int64)
            for i in range(len(q)):
                own = s[i][seed_rows != rows[i]]
                if len(own) >= k:
                    theta[i] = np.partition(own, len(own) - k)[len(own) - k]
            reach = theta > 0
            least[reach] = bucket_of((theta[reach] / norm[reach]) ** 2 * (1 - 1e-9)) - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(theta), pa.array(np.maximum(least, 0))], names=["row", "v", "norm2", "theta", "least"])

    return run


def _block(side: str):
    """One row for a block: numbers and ids of its rows, vectors and norms, longest first; for queries also their thetas."""

    def run(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        wide = table["v"].null_count > 0
        m, ids, rows, norm2 = _floats(table["x"]) if wide else _matrix(table["v"]), *(np.asarray(table[c].fill_null(0)) for c in ("vec_id", "row", "norm2"))
        order = np.lexsort((ids, -norm2))
        kind, data = _pack(m[order])
        theta = np.asarray(table["theta"])[order] if side == "q" else np.zeros(0, np.int64)
        numbers = {"rows": rows[order], "ids": ids[order], "norm2": norm2[order], "theta": theta}
        packed = {c: pa.array([x.astype("<i8").tobytes()], pa.binary()) for c, x in numbers.items()}
        return pa.table({"g": pa.array([keys[0].as_py()], pa.int64()), "chunk": pa.array([keys[1].as_py()], pa.int64()), "kind": [kind], "m": pa.array([data], pa.binary())} | packed).select([*_FIELDS])

    return run


def retrieve(q: np.ndarray, q_rows: np.ndarray, q_norm: np.ndarray, theta: np.ndarray, c: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, c_norm: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the query, ids, scores): up to k best of a block, none below theta. ``c`` comes longest first."""
    if not len(c) or not len(q):
        return
    unit = c / np.maximum(c_norm, 1e-300)[:, None]
    longest, index = max(float(c_norm[0]), 1e-300), {}
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where((theta > 0) & (q_norm > 0), theta / np.maximum(q_norm * longest, 1e-300), -1) * (1 - 1e-9)
        need = np.where((theta > 0) & (q_norm > 0), theta / np.maximum(q_norm, 1e-300) * (1 - 1e-9), -1)
    prefix = len(c) - np.searchsorted(c_norm[::-1], need, "left")  # candidates that are long enough

    def done(i: int, at: np.ndarray, scores: np.ndarray):
        ok = (scores >= theta[i]) & (c_rows[at] != q_rows[i])
        at, scores = at[ok], scores[ok]
        top = best(scores, c_ids[at], k)
        return i, c_ids[at[top]], scores[top]

    by_length = []
    for i in np.flatnonzero((prefix > 0) & (t <= 1)):
        if t[i] >= COORDINATE_FROM and c.shape[1] and c.shape[1] == q.shape[1]:
            f = int(np.abs(q[i]).argmax())
            if f not in index:
                order = np.argsort(unit[:, f], kind="stable")
                index[f] = order, unit[order, f]
            order, values = index[f]
            angle, wide = np.arccos(np.clip(q[i, f] / q_norm[i], -1, 1)), np.arccos(min(1.0, t[i]))
            lo = np.searchsorted(values, np.cos(min(np.pi, angle + wide)) - 1e-9, "left")
            hi = np.searchsorted(values, np.cos(max(0.0, angle - wide)) + 1e-9, "right")
            if hi - lo < prefix[i] // 4:
                at = order[lo:hi]
                at = at[at < prefix[i]]
                yield done(i, at, products(q[i : i + 1], c[at])[0])
                continue
        by_length.append(i)
    by_length = np.array(sorted(by_length, key=lambda i: prefix[i]), np.int64)
    step = max(1, (1 << 22) // len(c))
    for a in range(0, len(by_length), step):
        own = by_length[a : a + step]
        s = products(q[own], c[: prefix[own[-1]]])
        for row, i in enumerate(own.tolist()):
            yield done(i, np.arange(prefix[i]), s[row, : prefix[i]])


def _score(k: int, scale: int):
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("level", pa.int32()), ("score", pa.int64()), ("tail", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                row = batch.slice(j, 1).to_pylist()[0]
                q_rows, q_ids, q_norm2, theta = (np.frombuffer(row[f"q_{x}"], "<i8") for x in ("rows", "ids", "norm2", "theta"))
                c_rows, c_ids, c_norm2 = (np.frombuffer(row[f"c_{x}"], "<i8") for x in ("rows", "ids", "norm2"))
                q, c = _unpack(row, "q", scale), _unpack(row, "c", scale)
                if object in (q.dtype, c.dtype):
                    found = whole_scores(q, q_rows, c, c_rows, c_ids, k)
                else:
                    found = retrieve(q, q_rows, np.sqrt(q_norm2.astype(np.float64)), theta, c, c_rows, c_ids, np.sqrt(c_norm2.astype(np.float64)), k)
                if found := [x for x in found if len(x[1])]:
                    at = np.repeat([i for i, _, _ in found], [len(x) for _, x, _ in found])
                    level, score, tail = zip(*(order_of(int(s)) for _, _, scores in found for s in scores), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(q_rows[at]), pa.array(q_ids[at]), pa.array(np.concatenate([x for _, x, _ in found])), *(pa.array(x, f.type) for x, f in zip((level, score, tail), list(schema)[3:], strict=True))], schema=schema)

    return run


_FIELDS = {"g": "long", "chunk": "long", "rows": "binary", "ids": "binary", "kind": "string", "m": "binary", "norm2": "binary", "theta": "binary"}


def top_k(df: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, block: int = BLOCK, query_block: int = QUERY_BLOCK, seeds: int = SEEDS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id is divisible by ``every``.

    ``df`` has vec_id and embedding (array of floats or doubles); other columns are ignored. A query's own row is
    no candidate; other rows with its vec_id are. Rows that share a vec_id are ranked each, and each is a query if
    its id is. Ties go to the smaller vec_id. Null ids, null vectors and vectors with null or non-finite components
    take no part. Vectors of unequal lengths count as ending in zeros. A table with no other rows gives no rows.
    Components of any size rank exactly; a score beyond 64 bits shows as the nearest long.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    bucket = F.when(F.col("x").isNotNull(), WIDE).otherwise(F.least(F.floor(2 * F.log2(F.col("norm2").cast("double") + 1)), F.lit(WIDE - 1))).cast("long")
    vectors = materialise(integer_vectors(df, scale).withColumn("g", bucket).withColumn("row", F.monotonically_increasing_id()), "vectors")
    # bounded by constants: BUCKETS rows, and SEEDS vectors
    sizes = {r["g"]: r["n"] for r in vectors.groupBy("g").agg(F.count("*").alias("n")).collect()}
    first = vectors.where("x is null").orderBy(F.desc("norm2"), "vec_id").limit(seeds).select("row", "v").collect()
    width = max((len(r["v"]) for r in first), default=0)
    matrix = np.array([[*r["v"], *[0] * (width - len(r["v"]))] for r in first], np.int64).reshape(len(first), width)
    thetas = _thetas(matrix, np.array([r["row"] for r in first], np.int64), k)
    asked = vectors.where(F.col("vec_id") % every == 0)
    bounds = asked.where("x is null").select("row", "v", "norm2").mapInArrow(thetas, "row long, v array<long>, norm2 long, theta long, least long")
    ids = asked.select("row", "vec_id")
    queries = bounds.withColumnRenamed("least", "g").join(ids, "row").select("g", "row", "vec_id", "v", F.lit(None).cast("array<double>").alias("x"), "norm2", "theta")
    # wide queries meet every block
    queries = materialise(queries.unionByName(asked.where("x is not null").select(F.lit(-1).cast("long").alias("g"), "row", "vec_id", "v", "x", "norm2", F.lit(-(2**62)).cast("long").alias("theta"))), "queries")
    query_sizes = {r["g"]: r["n"] for r in queries.groupBy("g").agg(F.count("*").alias("n")).collect()}

    def numbers(n: dict[int, int], most: int):
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for g, c in n.items() for x in (g, -(-c // most))]), F.col("g")), F.lit(1)) if n else F.lit(1)

    def blocked(rows: DataFrame, side: str, n: dict[int, int], most: int) -> DataFrame:
        dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("row"), numbers(n, most).cast("long")))
        return materialise(dealt.groupBy("g", "chunk").applyInArrow(_block(side), ", ".join(f"{c} {t}" for c, t in _FIELDS.items())), f"{side}-blocks")

    cs = blocked(vectors.select("g", "row", "vec_id", "v", "x", "norm2"), "c", sizes, block)
    qs = blocked(queries, "q", query_sizes, query_block)
    # which blocks a query block meets: every block of every bucket from its least one on
    reach = F.explode(F.sequence(F.greatest("g", F.lit(0)), F.lit(WIDE).cast("long")))
    pairs = qs.select(F.col("g").alias("qg"), F.col("chunk").alias("qchunk"), reach.alias("g")).join(cs.select("g", "chunk"), "g")
    q_fields, c_fields = ("rows", "ids", "kind", "m", "norm2", "theta"), ("rows", "ids", "kind", "m", "norm2")
    left = qs.select(F.col("g").alias("qg"), F.col("chunk").alias("qchunk"), *(F.col(c).alias(f"q_{c}") for c in q_fields))
    right = cs.select("g", "chunk", *(F.col(c).alias(f"c_{c}") for c in c_fields))
    met = pairs.repartition("qg", "qchunk", "g", "chunk").join(F.broadcast(left) if sum(query_sizes.values()) <= query_block else left, ["qg", "qchunk"]).join(right, ["g", "chunk"])
    scored = met.select(*(f"q_{c}" for c in q_fields), *(f"c_{c}" for c in c_fields)).mapInArrow(_score(k, scale), "query long, query_id long, vec_id long, level int, score long, tail binary")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("level"), F.desc("score"), F.desc("tail"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
