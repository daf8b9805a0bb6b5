"""Phrase collocations by vertical positional inverted lists.

Documents become blocks: for each language of a batch of documents, the words that occur and for each word the sorted
list of its positions, numbered through the block with a gap between pieces of text, so that words stand side by
side exactly where positions differ by one. Blocks are stored once. The lists of all blocks together are a word's
occurrences, and their lengths its exact frequency.

Phrases grow by a word at a time. Within a block the lists of frequent phrases are merge-joined with the postings one
position further on; the joined lists' lengths are summed over blocks by a grouped aggregation, and phrases with enough
occurrences go on. A phrase can only be frequent if both phrases one word shorter within it are, which blocks ask a
Bloom filter of bounded size: a false hit costs a count that the sum then removes, and never changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import LARGE_ROWS, bounded_batches, materialise, small_splits, texts

LEAST = 10
LONGEST = 3
FIRST = 2000
#: A candidate goes if a longer one holds it and has this many hundredths of its occurrences or more.
COVERED = 50
UNDETERMINED = "und"
#: Bits of a filter for each phrase in it, and its largest size in bits (32 MB); beyond it more phrases pass for nothing.
BITS, LARGEST_FILTER = 16, 1 << 28
#: Parts in which a language's candidates are ranked first.
SALTS = 64
#: Bytes of stored blocks that a task reads: its phrases are held until it has combined their counts.
SPLIT = 8 << 20

_GAP = b"\xff"  # never a byte of a text
_FOLD = bytes(0xFF if chr(c) in ".,;:!?\n\v\f\r" else 32 if c == 9 else c for c in range(256))

BLOCK = "lang string, words array<string>, lengths array<long>, positions binary"
_BLOCK = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("lengths", pa.list_(pa.int64())), ("positions", pa.binary())])


class _Codes(dict):
    """Numbers of words, in the order in which they come; the gap is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def block_of(documents: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of a block, the lengths of their lists, and the lists one after the other."""
    codes = _Codes({_GAP: 0})
    runs = []
    for text in documents:
        words = text.encode("utf-8").lower().translate(_FOLD).replace(_GAP, b" \xff ").split()
        words.append(_GAP)
        runs.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
    line = np.concatenate(runs) if runs else np.zeros(0, np.int32)
    lengths = np.bincount(line, minlength=len(codes))
    positions = np.argsort(line, kind="stable").astype(np.int32)[lengths[0] :]
    return [w.decode("utf-8") for w in list(codes)[1:]], lengths[1:], positions


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, documents in by.items():
            words, lengths, positions = block_of(documents)
            if words:
                steps = np.diff(positions, prepend=np.int32(0))  # small numbers are stored in less room
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([words], pa.list_(pa.string())), pa.array([lengths.tolist()], pa.list_(pa.int64())), pa.array([steps.astype("<i4").tobytes()], pa.binary())], schema=_BLOCK)


def inverted_lists(docs: DataFrame) -> DataFrame:
    """Blocks of ``docs`` (lang, text): lang, words, lengths of their lists, and positions (as steps) of all lists in turn."""
    bounded_batches(docs.sparkSession)
    lang, text = F.coalesce(F.col("lang").cast("string"), F.lit(UNDETERMINED)), F.col("text").cast("string")
    return docs.select(lang.alias("lang"), text.alias("text")).mapInArrow(_blocks, BLOCK)


def _hashes(lang: str, words: list[str]) -> np.ndarray:
    """The same as xxhash64(lang, word) of Spark's."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w.encode(), seed) for w in words), np.uint64, len(words))


def _mixed(parts: list) -> Column:
    """One number for a phrase's words, as in ``Filter.holds``."""
    out = F.xxhash64("lang", parts[0])
    for p in parts[1:]:
        out = F.shiftleft(out, 1).bitwiseXOR(F.xxhash64("lang", p))
    return out


class Filter:
    """A Bloom filter with one bit a phrase."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    @classmethod
    def of(cls, phrases: DataFrame, words: list[str]) -> Filter:
        """Of the rows of ``phrases`` (lang and ``words``); built in tasks, by runs of 32,768 bits."""
        size = 1 << 15
        while size < min(LARGEST_FILTER, BITS * phrases.count()):
            size <<= 1
        bit = _mixed([F.col(w) for w in words]).bitwiseAND(F.lit(size - 1).cast("long"))
        runs = phrases.select(bit.alias("b")).groupBy((F.col("b") / 32768).cast("int").alias("run")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("b") % 32768 + 1)).alias("bits"))
        bits = np.zeros(size // 8, np.uint8)
        for r in runs.toLocalIterator():
            bits[r["run"] * 4096 : (r["run"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
        return cls(bits)


def merge_join(lists: np.ndarray, ends: np.ndarray, postings: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``lists`` whose end is followed by a posting, and that posting's word.

    ``lists``: numbers of phrases, ``ends``: the positions of their last words, rising; ``postings``: rising positions.
    """
    at = np.searchsorted(postings, ends + 1).astype(np.int32)
    ok = at < len(postings)
    ok[ok] = postings[at[ok]] == ends[ok] + 1
    return np.flatnonzero(ok).astype(np.int32), words[at[ok]]


def grow(lang: str, words: list[str], lengths: np.ndarray, positions: np.ndarray, filters: list[Filter]) -> tuple[list[np.ndarray], np.ndarray]:
    """Word numbers (an array for each place in the phrase) and list lengths of a block's phrases of ``len(filters) + 1`` words.

    ``filters``: of frequent words, then of frequent phrases of two words and so on.
    """
    hashes = _hashes(lang, words)
    kept = filters[0].holds(hashes)
    word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    chosen = kept[word]
    postings, word = positions[chosen], word[chosen]
    order = np.argsort(postings, kind="stable").astype(np.int32)
    postings, word = postings[order], word[order]
    del chosen, order
    phrases, lists, ends = [np.arange(len(words), dtype=np.int32)], word, postings
    for size in range(2, len(filters) + 2):
        at, following = merge_join(lists, ends, postings, word)
        codes, lists = np.unique(lists[at].astype(np.int64) * len(words) + following, return_inverse=True)
        lists = lists.astype(np.int32)
        ends = postings[np.searchsorted(postings, ends[at] + 1)] if len(at) else ends[:0]
        phrases = [*(p[codes // len(words)] for p in phrases), (codes % len(words)).astype(np.int32)]
        del codes, at, following
        if size >= 3:  # the phrase without its first word must be frequent too
            tail = hashes[phrases[1]]
            for p in phrases[2:]:
                tail = (tail << np.uint64(1)) ^ hashes[p]
            ok = filters[size - 2].holds(tail)
            phrases, lists, ends = _only(ok, phrases, lists, ends)
        if size <= len(filters):  # and it itself, to go on
            whole = hashes[phrases[0]]
            for p in phrases[1:]:
                whole = (whole << np.uint64(1)) ^ hashes[p]
            phrases, lists, ends = _only(filters[size - 1].holds(whole), phrases, lists, ends)
    return phrases, np.bincount(lists, minlength=len(phrases[0]))


def _only(ok: np.ndarray, phrases: list[np.ndarray], lists: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The phrases that are ``ok``, numbered anew, and their lists."""
    held = ok[lists]
    return [p[ok] for p in phrases], (np.cumsum(ok, dtype=np.int32) - 1)[lists[held]], ends[held]


def _extend(held, size: int):
    names = ["lang", *(f"w{k}" for k in range(1, size + 1)), "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = held.value
        for batch in batches:
            for row in batch.to_pylist():
                positions = np.cumsum(np.frombuffer(row["positions"], "<i4"), dtype=np.int32)
                phrases, n = grow(row["lang"], row["words"], np.array(row["lengths"]), positions, filters)
                dictionary = pa.array(row["words"], pa.string())
                for a in range(0, len(n), 100_000):
                    own = [dictionary.take(pa.array(p[a : a + 100_000])) for p in phrases]
                    yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(own[0])), *own, pa.array(n[a : a + 100_000], pa.int64())], names=names)

    return run


def _frequent(counts: DataFrame, words: list[str], least: int) -> DataFrame:
    # lengths of lists combine before the shuffle: a word in every block is a row a task
    return counts.groupBy("lang", *words).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def frequent_phrases(blocks: DataFrame, least: int = LEAST, longest: int = LONGEST) -> list[DataFrame]:
    """For 1, 2 to ``longest`` words: lang, w1, w2 and so on, n, of the phrases with ``least`` occurrences or more.

    The first table has all words and their frequencies, whatever they are.
    """
    spark = blocks.sparkSession
    words = blocks.select("lang", F.explode(F.arrays_zip(F.col("words").alias("w1"), F.col("lengths").alias("n"))).alias("p")).select("lang", "p.w1", "p.n")
    with small_splits(spark, SPLIT):
        tables = [materialise(_frequent(words, ["w1"], 0), "words")]
    filters = [Filter.of(tables[0].where(F.col("n") >= least), ["w1"])]
    for size in range(2, longest + 1):
        names = [f"w{k}" for k in range(1, size + 1)]
        held = spark.sparkContext.broadcast(filters)  # LARGEST_FILTER bits each at most
        counts = blocks.mapInArrow(_extend(held, size), f"lang string, {', '.join(f'{n} string' for n in names)}, n long")
        with small_splits(spark, SPLIT):
            tables.append(materialise(_frequent(counts, names, least), f"phrases-{size}"))
        filters = [*filters, Filter.of(tables[-1], names)] if size < longest else filters
    return tables


def _scored(tables: list[DataFrame], size: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates of ``size`` words: of their cuts the lowest score, the first of equal ones.

    Decimals of 38 digits hold the products exactly up to 10^15 occurrences of a phrase and 10^19 of its parts.
    """
    words = [f"w{k}" for k in range(1, size + 1)]
    rows, cuts = tables[size - 1].withColumnRenamed("n", "a"), []
    for k in range(1, size):
        for side, own in (("l", words[:k]), ("r", words[k:])):
            part = tables[len(own) - 1]
            names = dict(zip([f"w{j}" for j in range(1, len(own) + 1)], own, strict=True))
            rows = rows.join(part.select("lang", *(F.col(x).alias(y) for x, y in names.items()), F.col("n").alias(f"{side}{k}")), ["lang", *own])
        score = F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0))) div (CAST(l{k} AS DECIMAL(19, 0)) * CAST(r{k} AS DECIMAL(19, 0)))")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    lowest = F.array_min(F.array(*cuts))
    return rows.select("lang", F.concat_ws(" ", *words).alias("phrase"), "a", lowest.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``first`` phrases of each lang by score, then a, then the phrase.

    ``docs`` has text and lang; other columns are ignored. Null lang is ``und`` (as is a lang of that name), null and
    empty text holds no words, texts of any length are read whole. Repeated rows and copies count each time they occur.
    Ties in score and a go to the phrase that is less in bytes. An empty table, or one in which no phrase has ``least``
    occurrences, gives no rows. A phrase goes if a longer candidate of at most ``longest`` words holds it and has half
    of its occurrences or more, whether that one stays or goes.
    """
    blocks = materialise(inverted_lists(docs), "positions", LARGE_ROWS)
    tables = frequent_phrases(blocks, least, longest)
    out = None
    for size in range(2, longest + 1):
        rows = _scored(tables, size)
        for longer in range(size + 1, longest + 1):
            held = [F.concat_ws(" ", *(f"w{k}" for k in range(at, at + size))) for at in range(1, longer - size + 2)]
            covers = tables[longer - 1].select("lang", F.explode(F.array(*held)).alias("phrase"), F.col("n").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
            rows = rows.join(covers, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < COVERED * F.col("a"))).drop("longer")
        out = rows if out is None else out.unionByName(rows)
    # the first of each part, then of all parts: one language may hold most candidates
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = out.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= first)
    total = tables[0].groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
