"""MinHash near-duplicates with odd sketches.

1. Every document gives its set of word shingles (64-bit hashes), a MinHash, band keys of it, and an odd sketch:
   a bitmap of the parities of the hashed MinHash samples. Documents with equal sets form a class; one
   representative of each goes on.
2. A band key's documents are compared with two leaders of the bucket, its least and its most central member: each
   takes, of all its leaders, the one whose sketch is most similar (population count of the XOR), and the pair is confirmed on the full sets.
   Connected components follow from confirmed links.
3. Only members of a bucket that are still in different components are compared further: the members outside the
   bucket's largest component against all others, block by block, by sketches and by a parity bitmap of the whole
   shingle set; what may reach the threshold is confirmed on the full sets. So no link that bands can find between
   different components is lost, and hot buckets cost in proportion to what is unlinked rather than their square.

Texts move once: the sets of all documents that share a bucket are stored after one shuffle. To confirm links, each
link takes one of its sets to the other's group, which holds the other set once for ``GROUP`` links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, materialise, texts, with_key
from .components import components

WORDS = 3
PERCENT = 85
#: MinHash samples, and the most of them in a band key; lower thresholds take fewer, so that bands miss a link at any of them once in MISS at most.
SAMPLES, ROWS = 192, 6
MISS = 1_000_000
SKETCH_BITS = 1024
#: Standard deviations that a linked pair's estimate from sketches may be under the threshold.
SKETCH_SIGMAS = 6
#: Bits of the parity bitmap of a whole shingle set, and the standard deviations that a pair may be over the threshold's expectation.
PARITY_BITS, PARITY_SIGMAS = 2048, 5
#: Members of a bucket compared at once, and links of one document confirmed at once.
BLOCK = 512
GROUP = 512

_RNG = np.random.default_rng(20240607)
_K = SAMPLES
_MUL = _RNG.integers(0, 1 << 32, _K, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, _K, dtype=np.uint32)
_MIX = _RNG.integers(0, 1 << 63, (3, ROWS), dtype=np.uint64) | np.uint64(1)
#: Words whose hashes a task keeps, and the longest of them in bytes; they bound memory only.
CACHE_WORDS, CACHE_BYTES = 100_000, 64


class _Words(dict):
    """Hashes of words; bounded."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = h
        return h


_WORDS = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of the whole sequence if it has fewer words; empty without words.

    Words are runs of characters other than space and U+0009 to U+000D, with A to Z lower-cased.
    """
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, w), np.uint64, len(w))
    n = min(words, len(w))
    out = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mixed(out + h[k : len(h) - n + 1 + k])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def minhash(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(_K, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 256):
        y = np.multiply.outer(x[a : a + 256], _MUL)
        y += _ADD
        np.minimum(least, y.min(0), out=least)
    return least


def rows_of(percent: int) -> int:
    """Samples in a band key: as many as let bands miss a link at the threshold once in MISS at most; one, if none do."""
    return next((r for r in range(ROWS, 1, -1) if (1 - (percent / 100) ** r) ** (_K // r) <= 1 / MISS), 1)


def band_keys(signature: np.ndarray, n: int = ROWS) -> np.ndarray:
    """Keys of as many bands of ``n`` samples as there are."""
    bands = _K // n
    rows = signature[: bands * n].reshape(bands, n).astype(np.uint64)
    keys = (rows * _MIX[0, :n]).sum(1) + np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return _mixed(keys ^ _mixed((rows * _MIX[1, :n]).sum(1))).astype(np.int64)


def odd_sketch(signature: np.ndarray) -> bytes:
    at = _mixed(signature.astype(np.uint64) + (np.arange(_K, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).tobytes()


def similarity(differing: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity from the population count of two sketches' XOR."""
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.maximum(1 - 2 * np.asarray(differing, np.float64) / SKETCH_BITS, 1e-9)
    return np.maximum(1 + SKETCH_BITS / (4 * _K) * np.log(left), 0)


def slack(percent: int) -> float:
    """How far under the threshold the estimate of a pair at it may be: SKETCH_SIGMAS standard deviations.

    They are those of the share of equal samples and of the cells with an odd count in the sketches' XOR.
    """
    j = percent / 100
    d = 2 * _K * (1 - j)
    left = np.exp(-2 * d / SKETCH_BITS)
    cells = SKETCH_BITS / 4 * (1 - left**2) - d * left**2
    return float(SKETCH_SIGMAS * np.sqrt(j * (1 - j) / _K + max(cells, 0.0) / (2 * _K * left) ** 2))


def parity_of(shingles: np.ndarray) -> bytes:
    """Odd sketch of the whole set."""
    return np.packbits(np.bincount((shingles % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1).tobytes()


def most_differing(total: np.ndarray, percent: int) -> np.ndarray:
    """Bits in which the parity bitmaps of two linked sets can differ; ``total``: the sum of the sets' sizes.

    Linked sets differ in (100 - percent) / (100 + percent) of ``total`` elements at most; the mean and variance
    are those of the cells with an odd count when so many fall at random.
    """
    d = np.asarray(total, np.float64) * (100 - percent) / (100 + percent)
    left = np.exp(-2 * d / PARITY_BITS)
    variance = PARITY_BITS / 4 * (1 - left**2) - d * left**2
    return PARITY_BITS / 2 * (1 - left) + PARITY_SIGMAS * np.sqrt(np.maximum(variance, 0)) + 2


SIGNATURES = "__id long, n long, fp1 long, fp2 long, bands array<long>, sketch binary"


def _sign(words: int, rows: int):
    schema = pa.schema([("__id", pa.int64()), ("n", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                s = shingle_set(text, words)
                if not len(s):
                    out.append((doc, 0, 0, 0, None, None))
                    continue
                sig, fp = minhash(s), xxhash.xxh3_128_intdigest(s)
                out.append((doc, len(s), (fp >> 64) - (1 << 63), (fp & ((1 << 64) - 1)) - (1 << 63), band_keys(sig, rows), odd_sketch(sig)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)
        _WORDS.clear()

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x, words) for x in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([parity_of(x) for x in found], pa.binary())], names=["__id", "s", "parity"])
        _WORDS.clear()

    return run


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets' similarity is ``percent`` / 100 or more."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int):
    """Of rows ordered by (b, salt, a), the first of a group being the set of ``b`` itself (a is null), the links (a, b) that hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for batch in batches:
            left, right = [], []
            for b, salt, a, s in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                x = np.frombuffer(s, np.uint64)
                if at != (b, salt):
                    at, own = (b, salt), []
                if a is None:  # one row, unless rows share a doc_id
                    own.append(x)
                elif any(linked(x, y, percent) for y in own):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b; distinct) those whose full shingle sets (``sets``: id, s) reach the threshold.

    Of each pair the document with more pairs is ``b``: its set goes once to each group of its links, the other's
    set goes to the group. Groups of a document with many links are dealt over tasks. ``pairs`` should be stored.
    """
    degrees = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    known = pairs.join(degrees.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(degrees.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    swap = (F.col("da") > F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    links = known.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), F.ceil(F.greatest("da", "db") / F.lit(float(GROUP))).cast("int").alias("groups"))
    links = materialise(links.select("a", "b", F.pmod(F.xxhash64("a"), F.col("groups")).cast("int").alias("salt")), "links")
    # a merge join at every size: sets are too large to be sent to all machines
    own = links.select("b", "salt").distinct().join(sets.hint("merge"), F.col("b") == F.col("id")).select("b", "salt", F.lit(None).cast("long").alias("a"), "s")
    others = links.join(sets.hint("merge"), F.col("a") == F.col("id")).select("b", "salt", "a", "s")
    both = own.unionByName(others).repartition(_tasks(pairs.sparkSession), "b", "salt").sortWithinPartitions("b", "salt", F.asc_nulls_first("a"))
    return both.mapInArrow(_confirm(percent), "a long, b long")


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similarity(np.bitwise_count(x ^ y).sum(1)))], names=["a", "b", "j"])


def _compare(percent: int):
    """Pairs of one block pair whose components differ and whose sizes and sketches allow the threshold.

    A pair comes from the first of the buckets that it shares alone: all of those hold two components, so all are compared.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    least = percent / 100 - slack(percent)

    def run(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, n, comp, side = (np.asarray(table[c]) for c in ("id", "n", "comp", "side"))
        bits, parities = (np.frombuffer(b"".join(table[c].to_pylist()), np.uint64).reshape(len(ids), -1) for c in ("sketch", "parity"))
        bands = np.asarray(table["bands"].combine_chunks().flatten()).reshape(len(ids), -1)
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        a, b = [], []
        for i in left.tolist():
            near = right[(comp[right] != comp[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
            if len(near):
                near = near[similarity(np.bitwise_count(bits[near] ^ bits[i]).sum(1)) >= least]
                near = near[np.bitwise_count(parities[near] ^ parities[i]).sum(1) <= most_differing(n[near] + n[i], percent)]
                near = near[bands[i, (bands[near] == bands[i]).argmax(1)] == keys[0].as_py()]
                a.append(np.full(len(near), ids[i]))
                b.append(ids[near])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)}, schema=schema)

    return run


def _tasks(spark) -> int:
    """Tasks of a stage whose work isn't told by its bytes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``; other columns are ignored.

    Documents are linked if their shingle sets' Jaccard similarity is ``percent`` / 100 or more; component_id is
    the least doc_id reachable by links. Null and empty texts, and texts without words, have no shingles and are
    linked with nothing. Rows that share a doc_id count as one document. A null doc_id is less than any
    other. An empty table gives an empty result. Computed, a link at the threshold is missed by bands once in 3.8
    million at 85 percent and 3.6 million at 80, and by sketches once in 15 million and 11 million.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = with_key(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")), "doc_id").select("__id", "text")
    signed = materialise(docs.mapInArrow(_sign(words, rows_of(percent)), SIGNATURES), "signatures")
    some = signed.where("n > 0")
    classes = materialise(some.groupBy("fp1", "fp2").agg(F.min("__id").alias("rep")), "classes")
    # one row a class: the row of its least id
    reps = materialise(some.join(classes.withColumnRenamed("rep", "__id"), ["fp1", "fp2", "__id"]).dropDuplicates(["fp1", "fp2", "__id"]).select(F.col("__id").alias("id"), "n", "bands", "sketch"), "representatives")
    buckets = reps.select("id", F.explode("bands").alias("key"))
    sizes = buckets.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("l0")).where("m > 1")
    members = materialise(buckets.join(sizes, "key"), "members")
    # the one shuffle of texts. A merge join at every size: the ids of members are as many as the corpus has copies
    shared = docs.join(members.select(F.col("id").alias("__id")).distinct().hint("merge"), "__id", "left_semi")
    sets = materialise(shared.mapInArrow(_sets(words), "__id long, s binary, parity binary").select(F.col("__id").alias("id"), "s", "parity"), "shingles")
    # a text from which others were copied shares more and larger buckets with them than they do with each other
    central = members.join(members.groupBy("id").agg(F.sum("m").alias("c")), "id")
    hubs = central.groupBy("key").agg(F.max(F.struct("c", (-F.col("id")).alias("i"))).alias("top")).select("key", (-F.col("top.i")).alias("l1"))
    star = members.join(hubs, "key").select("id", F.explode(F.array("l0", "l1")).alias("leader")).where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    sketches = reps.select("id", "sketch", "n")
    both = star.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na")), "a").join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb")), "b")
    both = both.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b", "sa", "sb").mapInArrow(_estimated, "a long, b long, j double")
    nearest = both.where(F.col("j") >= percent / 100 - slack(percent)).groupBy("a").agg(F.max_by("b", F.struct("j", -F.col("b"))).alias("b"))
    first = components(confirmed(materialise(nearest, "star"), sets, percent))
    # what is still apart within a bucket
    apart = members.select("key", "id").join(first.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("comp"))
    apart = materialise(apart, "apart")
    sizes = apart.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("major"), F.sum("c").alias("m"), F.max("c").alias("most")).where("m > most")
    open_ = materialise(apart.join(sizes, "key"), "open")
    open_ = open_.join(reps.select("id", "n", "sketch", "bands").join(sets.select("id", "parity"), "id"), "id").withColumn("minor", F.col("comp") != F.col("major"))
    minors, majors = (F.ceil(x / F.lit(float(BLOCK))).cast("int") for x in (F.col("m") - F.col("most"), F.col("most")))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.greatest(n, F.lit(1))).cast("int")
    own = F.when(F.col("minor"), deal(minors)).otherwise(deal(majors))
    # block pairs: minor blocks i <= j among themselves, every minor block with every major block. side: 1 left, 2 right, 3 both
    with_minor = F.transform(F.sequence(F.lit(0), minors - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), F.when(own == j, 3).when(own < j, 1).otherwise(2).alias("side")))
    with_major = F.transform(F.sequence(F.lit(0), majors - 1), lambda j: F.struct(own.alias("i"), (-1 - j).alias("j"), F.lit(1).alias("side")))
    from_major = F.transform(F.sequence(F.lit(0), minors - 1), lambda i: F.struct(i.alias("i"), (-1 - own).alias("j"), F.lit(2).alias("side")))
    met = open_.select("key", "id", "n", "comp", "sketch", "parity", "bands", F.explode(F.when(F.col("minor"), F.concat(with_minor, with_major)).otherwise(from_major)).alias("p")).select("key", "p.i", "p.j", "p.side", "id", "n", "comp", "sketch", "parity", "bands")
    pairs = materialise(met.repartition(_tasks(spark), "key", "i", "j").groupBy("key", "i", "j").applyInArrow(_compare(percent), "a long, b long").distinct(), "pairs")
    more = confirmed(pairs, sets, percent)
    roots = first.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    more = more.join(roots, "a", "left").join(roots.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    second = components(more)
    root = first.join(second.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    root = root.unionByName(second.join(first, "node", "left_anti").select("node", "root"))
    # every row: class, component
    found = classes.join(root.withColumnRenamed("node", "rep"), "rep", "left").select("fp1", "fp2", F.coalesce("root", "rep").alias("c"))
    # a document that shares its id with rows of other classes belongs to all of them: the least is taken
    out = signed.select("__id", "n", "fp1", "fp2").join(found, ["fp1", "fp2"], "left").withColumn("c", F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("__id")))
    null = F.lit(-(2**63))
    shown = lambda c: F.when(F.col(c) != null, F.col(c))
    return out.select(shown("__id").alias("doc_id"), F.col("n").alias("n_shingles"), shown("c").alias("component_id"), (F.col("__id") == F.col("c")).alias("kept"))
