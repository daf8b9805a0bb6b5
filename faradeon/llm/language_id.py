"""Language ID by prediction by partial matching.

For each language, a byte context tree of orders 0 to ``ORDER`` with escapes (method C, with exclusion: after an
escape, what the longer context has seen gets no share) is counted on a bounded sample of labelled documents and
frozen. Only contexts and symbols that were seen are stored, so all bytes stay apart and every language has the same
order, however many there are. A text's code length under a language is the exact sum over all its bytes, in 1/1024
bit: of the longest context that has seen the byte, plus the escapes from the longer ones that have not. The
language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ._shared import bounded_batches, texts

ORDER = 3
#: The sample: documents a language, and the sum of their bytes. It bounds what is learned from, nothing else.
PER_LANGUAGE, SAMPLE_BYTES = 400, 1 << 20
#: Groups of one language's documents that are ranked apart first.
SALTS = 16
#: Languages whose trees are looked up together; it bounds memory, not the result.
PANEL = 16
UNIT = 1024
UNDETERMINED = "und"
_CHUNK = 1 << 18

#: Bytes as the trees see them: A to Z lower-cased, ASCII that is no letter one symbol (a space), all others themselves.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
SYMBOLS = len(np.unique(FOLD))


def _grams(folded: np.ndarray, length: int) -> np.ndarray:
    """Every run of ``length`` bytes as a number; ``folded`` begins with ORDER spaces before its first symbol."""
    n = len(folded) - ORDER
    key = np.zeros(n, np.int64)
    for j in range(ORDER + 1 - length, ORDER + 1):
        key = key << 8 | folded[j : j + n]
    return key


def _at(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in ascending ``keys``; -1 if absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass(frozen=True)
class Tree:
    """One language's frozen tree: by order, the runs (context and symbol) seen with their probability, and contexts with their escape's share."""

    runs: list[np.ndarray]
    seen: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    @classmethod
    def count(cls, samples: list[bytes], order: int = ORDER) -> Tree:
        runs, seen, contexts, escapes = [], [], [], []
        tree = cls(runs, seen, contexts, escapes)
        padded = [np.concatenate([np.full(ORDER, 32, np.uint8), FOLD[np.frombuffer(x, np.uint8)]]) for x in samples]
        for k in range(order + 1):
            all_runs = np.concatenate([_grams(x, k + 1) for x in padded]) if padded else np.zeros(0, np.int64)
            run, times = np.unique(all_runs, return_counts=True)
            context, of, kinds = np.unique(run >> 8, return_inverse=True, return_counts=True)
            n = np.bincount(of, times, len(context))
            # what the seen symbols would get from the shorter context is not shared out by the escape
            rest = 1 - np.bincount(of, tree._probability(run & ((1 << 8 * k) - 1 if k else 255), k - 1), len(context))
            escape = np.where(kinds < SYMBOLS, kinds / np.maximum(n + kinds, 1), 0)
            runs.append(run)
            seen.append(times / n[of] * (1 - escape[of]))
            contexts.append(context)
            escapes.append(escape / np.maximum(rest, 1e-12))
        return tree

    def _probability(self, run: np.ndarray, order: int) -> np.ndarray:
        """Of each run's last symbol after the run's context of ``order`` symbols."""
        if order < 0:
            return np.full(len(run), 1 / SYMBOLS)
        at = _at(self.runs[order], run)
        out = np.where(at >= 0, self.seen[order][at] if len(self.runs[order]) else 0, 0.0)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            lower = self._probability(run[miss] & ((1 << 8 * order) - 1 if order else 255), order - 1)
            c = _at(self.contexts[order], run[miss] >> 8)
            out[miss] = np.where(c >= 0, self.escapes[order][c] if len(self.contexts[order]) else 1, 1.0) * lower
        return out


class Lookup:
    """Places of 64-bit keys in a list of distinct ones, by a hash table in arrays."""

    def __init__(self, keys: np.ndarray):
        self._keys = np.append(keys, -1)  # no key is negative: place -1 matches none
        self._shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self._table = np.full(1 << (64 - int(self._shift)), -1, np.int32)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = self._table[slot] < 0
            self._table[slot[free]] = left[free]  # of those that meet in a slot the last stays
            out = self._table[slot] != left
            slot, left = slot[out] + 1 & len(self._table) - 1, left[out]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self._shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; -1 if it isn't there."""
        slot = self._slots(keys)
        at = self._table[slot]
        left = np.flatnonzero((at >= 0) & (self._keys[at] != keys))
        while len(left):
            slot[left] = slot[left] + 1 & len(self._table) - 1
            at[left] = self._table[slot[left]]
            left = left[(at[left] >= 0) & (self._keys[at[left]] != keys[left])]
        return at


@dataclass
class Panel:
    """Trees of a few languages by their union of runs and of contexts, with code lengths of each under every language."""

    runs: list[np.ndarray]
    lengths: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    @classmethod
    def of(cls, trees: list[Tree]) -> Panel:
        code = lambda p: np.round(-np.log2(np.maximum(p, 1e-18)) * UNIT).astype(np.int32)
        runs, lengths, contexts, escapes = [], [], [], []
        for k in range(len(trees[0].runs)):
            run, context = (np.unique(np.concatenate([getattr(t, name)[k] for t in trees])) for name in ("runs", "contexts"))
            runs.append(run)
            lengths.append(np.stack([code(t._probability(run, k)) for t in trees], 1))
            contexts.append(context)
            at = [_at(t.contexts[k], context) for t in trees]
            escapes.append(np.stack([code(np.where(a >= 0, t.escapes[k][a] if len(t.escapes[k]) else 1, 1.0)) for t, a in zip(trees, at, strict=True)], 1))
        return cls(runs, lengths, contexts, escapes)

    def tables(self) -> list[tuple[Lookup, np.ndarray, Lookup, np.ndarray]]:
        """By order, the longest first: runs, their code lengths, contexts, their escapes' code lengths."""
        return [(Lookup(self.runs[k]), self.lengths[k], Lookup(self.contexts[k]), self.escapes[k]) for k in range(len(self.runs) - 1, -1, -1)]


def _add(total: np.ndarray, tables: list, folded: np.ndarray, doc: np.ndarray) -> None:
    """Adds each symbol's code lengths to its document's. ``folded``: ORDER symbols of context, then a symbol for each of ``doc``."""
    left = np.arange(len(doc))
    for k, (runs, lengths, contexts, escapes) in zip(range(len(tables) - 1, -1, -1), tables, strict=True):
        key = _grams(folded, k + 1)[left]
        at = runs(key)
        found = at >= 0
        _sum(total, lengths[at[found]], doc[left[found]])
        left, key = left[~found], key[~found]
        at = contexts(key >> 8)
        some = at >= 0
        _sum(total, escapes[at[some]], doc[left[some]])
        if not len(left):
            return
    # a byte that no language has seen
    _sum(total, np.full((len(left), total.shape[1]), round(np.log2(SYMBOLS) * UNIT), np.int32), doc[left])


def _sum(total: np.ndarray, rows: np.ndarray, doc: np.ndarray) -> None:
    if len(doc):
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        total[doc[first]] += np.add.reduceat(rows, first, 0, dtype=np.int64)


@dataclass
class Model:
    languages: list[str]
    panels: list[Panel]

    def __post_init__(self):
        self._tables = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language, in 1 / UNIT bit."""
        if self._tables is None:
            self._tables = [p.tables() for p in self.panels]
        pad, one = np.full(ORDER, 32, np.uint8), np.zeros(ORDER, bool)
        flat = np.concatenate([np.zeros(0, np.uint8), *(x for t in texts for x in (pad, FOLD[np.frombuffer(t, np.uint8)]))])
        real = np.concatenate([np.zeros(0, bool), *(x for t in texts for x in (one, np.ones(len(t), bool)))])
        doc = np.repeat(np.arange(len(texts)), [ORDER + len(t) for t in texts])
        out = [np.zeros((len(texts), p.lengths[0].shape[1]), np.int64) for p in self.panels]
        for a in range(ORDER, len(flat), _CHUNK):
            here = slice(a, min(a + _CHUNK, len(flat)))
            for total, tables in zip(out, self._tables, strict=True):
                # the symbols of padding are coded to a row of their own, which goes
                rows = np.zeros((len(total) + 1, total.shape[1]), np.int64)
                _add(rows, tables, flat[a - ORDER : here.stop], np.where(real[here], doc[here], len(total)))
                total += rows[:-1]
        return np.concatenate(out, 1) if out else np.zeros((len(texts), 0), np.int64)

    def predict(self, texts: list[str | None]) -> list[tuple[str | None, float]]:
        """(language, its share of the languages' probabilities) of each text; ('und', 0.0) without a letter, (None, 0.0) without languages."""
        lettered = [any(c.isalpha() for c in (t or "")) for t in texts]
        if not self.languages:
            return [(None if x else UNDETERMINED, 0.0) for x in lettered]
        bits = self.code_lengths([t.encode("utf-8", "surrogatepass") if x else b"" for t, x in zip(texts, lettered, strict=True)]) / UNIT
        best = bits.argmin(1)
        share = 1 / np.exp2(bits.min(1, keepdims=True) - bits).sum(1)
        return [(self.languages[b], float(s)) if x else (UNDETERMINED, 0.0) for b, s, x in zip(best.tolist(), share.tolist(), lettered, strict=True)]


def train(samples: dict[str, list[str]], order: int = ORDER, panel: int = PANEL) -> Model:
    """A model of texts by language; its size grows with the languages and their samples."""
    languages = sorted(samples)
    trees = [Tree.count([x.encode("utf-8", "surrogatepass") for x in samples[k]], order) for k in languages]
    return Model(languages, [Panel.of(trees[a : a + panel]) for a in range(0, len(trees), panel)])


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is held out of learning: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = SAMPLE_BYTES) -> dict[str, list[str]]:
    """The first documents of each language in the order of a hash of doc_id, of those not held out that have a letter.

    At most ``per_language`` documents of ``most`` bytes in all; a text that is longer than this alone comes after
    all others and is cut to it, so it is learned from only where its language has no other.
    """
    text = F.col("text")
    some = docs.where(F.col("lang").isNotNull() & text.isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & text.rlike(r"\p{L}"))
    size = F.octet_length(text)
    dealt = some.select("doc_id", "lang", F.when(size > most, most).otherwise(size).cast("long").alias("size"), (size > most).alias("long"), F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"))
    order = ["long", "h", "doc_id", "t"]
    # two steps, each cut before its shuffle, so that no language's documents meet in one task
    part = F.row_number().over(Window.partitionBy("lang", F.pmod("h", F.lit(SALTS))).orderBy(*order))
    whole = Window.partitionBy("lang").orderBy(*order)
    few = dealt.withColumn("r", part).where(F.col("r") <= per_language).withColumn("r", F.row_number().over(whole)).where(F.col("r") <= per_language)
    few = few.withColumn("sum", F.sum("size").over(whole.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("sum") <= most) | (F.col("r") == 1))
    ids = few.select("doc_id", "lang", "t").distinct()
    out: dict[str, list[str]] = {}
    # per_language rows of `most` bytes a language
    texts_ = some.withColumn("t", F.xxhash64("text")).join(F.broadcast(ids), ["doc_id", "lang", "t"]).select("doc_id", "lang", F.substring("text", 1, most).alias("text")).distinct()
    for r in texts_.orderBy("lang", "doc_id", "text").toLocalIterator():
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score, for every row; null texts and texts without a letter get 'und' and 0.

    Where no language could be learned, all other texts get null and 0. Equal texts get equal results; languages with
    equal code lengths go to the first by name. Whole texts of any length are coded. An empty table gives an empty
    result. Only ``text`` is looked at. All other columns pass through; those named lang_pred or score are replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)  # bounded by the languages and their samples
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = kept.index("text")
    schema = StructType([*(f for f in docs.schema if f.name in kept), StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            found = own.predict(texts(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.select(*(f"`{c}`" for c in kept)).mapInArrow(run, schema)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang; other columns are ignored).

    A null doc_id is not held out and not learned from. Nulls, empty and long texts, ties, repeated rows and empty
    tables: as in identify.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return identify(rows, train(sample(docs))).select("doc_id", "held_out", "lang_pred", "score")
