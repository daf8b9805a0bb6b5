"""Benchmark decontamination: BM25 over an inverted index of test items with block-max WAND, then overlap checks.

Every passage (overlapping windows of one size that cover all of every document) is a query. The index holds, for each
term, its BM25 impacts on units (an item's words, long items in parts), divided by the unit's score for itself, sorted
by unit, with the maximum of the list and of each of its blocks; units of like lengths have lists of their own. Of a
passage's lists those whose maxima together stay under the threshold are never read for candidates; a passage in which
no block of the others can reach it has no pivot. What is left is retrieved by block-max WAND: cursors over the sorted lists, a pivot where the lists' maxima reach the threshold, block maxima
that let a block be skipped, full scores only where both reach it. So nothing above the threshold is missed. Retrieved
items count as contamination if the question part and the answer part overlap with the passage in word shingles.

Terms' document frequencies and mean lengths are those of all items, whatever groups they are indexed in.
"""

from __future__ import annotations

import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, materialise, texts, with_key

K1, B = 1.2, 0.75
#: Share of its own score that a unit must get from a passage to be retrieved, and units in a block.
THRESHOLD = 0.5
BLOCK = 2
#: Share of the threshold that lists which aren't read for candidates may add up to.
SPARED = 0.2
#: Bands of units' lengths: up to 8 words, then 16, 32, 64 and more. A word's share of a unit's score falls with its length.
BANDS = 5
#: Words in a shingle, and the share of a part's shingles that a passage must hold.
WORDS = 5
OVERLAP = 0.8
#: Share of an item's words that is its question; the rest is its answer.
QUESTION = 2 / 3
#: Words of a passage; passages start every half of it, and units have half of it at most, so a whole unit is in one.
PASSAGE = 256
#: Characters of items in one index. More items are indexed in as many groups, each queried by all passages.
INDEX_CHARS = 32 << 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if chr(c) in string.punctuation else c for c in range(256))
#: Block maxima that are added up at once, and bytes of texts whose passages are matched at once (one text at least); they bound memory only.
ENTRIES = 1 << 17
MATCHED_BYTES = 512 << 10


def words_of(text: str) -> list[bytes]:
    """Words: A to Z lower-cased, ASCII punctuation as white space."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def shingles(words: list[bytes], n: int = WORDS) -> set[bytes]:
    """Distinct shingles; the whole sequence if it has fewer words."""
    n = min(n, len(words))
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def band_of(words: int) -> int:
    """Number of the band of a unit's length."""
    return min(BANDS - 1, max(0, (words - 1).bit_length() - 3))


class _Terms(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


@dataclass
class Statistics:
    """Of all units of all items: their number, their mean length in words, and how many hold a term."""

    units: int
    mean: float
    frequency: dict[bytes, int]

    @classmethod
    def of(cls, units: list[list[bytes]]) -> Statistics:
        return cls(len(units), sum(map(len, units)) / max(1, len(units)), Counter(t for w in units for t in set(w)))


def units_of(words: list[bytes]) -> list[list[bytes]]:
    """An item's words in equal parts of half a passage at most."""
    parts = max(1, -(-len(words) // (PASSAGE // 2)))
    cuts = [len(words) * k // parts for k in range(parts + 1)]
    return [words[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass
class Part:
    """Shingles of an item's question or answer: of WORDS words, or its single words if it has fewer."""

    size: int
    shingles: set[bytes]

    @classmethod
    def of(cls, words: list[bytes]) -> Part:
        size = WORDS if len(words) >= WORDS else 1
        return cls(size, shingles(words, size))


def answer_from(text: str, n: int) -> int:
    """How many of an item's ``n`` words are its question.

    It ends at the last question mark that words follow, or else at the last line feed that words stand on both sides of, or
    else after two thirds of the words; an item of one word is a question alone.
    """
    for mark in ("?", "\n"):
        at = len(text)
        while (at := text.rfind(mark, 0, at)) > 0:
            if 0 < (before := len(words_of(text[:at]))) < n:
                return before
    return max(1, round(n * QUESTION))


@dataclass
class Index:
    ids: list[int]  # of the item of each unit
    length: list[int]  # of that item, in words
    parts: list[tuple[Part, Part]]  # its question and answer
    terms: _Terms
    starts: np.ndarray  # of each term's postings
    units: np.ndarray
    impacts: np.ndarray
    top: np.ndarray  # of each term
    block_starts: np.ndarray  # of each term's blocks
    blocks: np.ndarray
    block_max: np.ndarray

    def __post_init__(self):
        self._lists: dict[int, tuple] = {}
        self._place = np.empty(len(self.top), np.int64)  # of a list among all, by rising maximum
        self._by_top = np.argsort(self.top, kind="stable")
        self._place[self._by_top] = np.arange(len(self.top))
        self.touched = 0  # block maxima that were read

    @classmethod
    def build(cls, items: list[tuple[int, list[bytes], int]], known: Statistics | None = None, block: int = BLOCK) -> Index:
        """Index of (id, words, words of its question); items without words are left out. ``known``: statistics of all items, if these are a group of them."""
        whole = sorted((x for x in items if x[1]), key=lambda x: (x[1], x[0]))
        parts = [(Part.of(w[:cut]), Part.of(w[cut:])) for _, w, cut in whole]
        # units of like lengths stand together, similar ones in the same blocks
        split = sorted(((k, u) for k, (_, w, _) in enumerate(whole) for u in units_of(w)), key=lambda x: band_of(len(x[1])))
        known = known or Statistics.of([u for _, u in split])
        terms = _Terms((t, k) for k, t in enumerate(sorted({t for _, u in split for t in u})))
        term, unit, impact = [], [], []  # a term's list in a band of lengths has the number band * terms + term
        for k, (_, w) in enumerate(split):
            score = {t: np.log(1 + (known.units - known.frequency[t] + 0.5) / (known.frequency[t] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(w) / known.mean)) for t, n in Counter(w).items()}
            own = sum(score.values())
            for t, s in score.items():
                term.append(band_of(len(w)) * len(terms) + terms[t])
                unit.append(k)
                impact.append(s / own)
        term, unit, impact = np.array(term, np.int64), np.array(unit, np.int64), np.array(impact, np.float64)
        order = np.lexsort((unit, term))
        term, unit, impact = term[order], unit[order], impact[order]
        blocks = unit // block
        first = np.flatnonzero(np.concatenate([[True], (np.diff(term) != 0) | (np.diff(blocks) != 0)])) if len(term) else np.zeros(0, np.int64)
        at = np.arange(BANDS * len(terms) + 1)
        starts = np.searchsorted(term, at)
        block_max = np.maximum.reduceat(impact, first) if len(term) else impact
        top = np.zeros(len(at) - 1)
        np.maximum.at(top, term, impact)
        return cls([whole[k][0] for k, _ in split], [len(whole[k][1]) for k, _ in split], [parts[k] for k, _ in split], terms, starts, unit, impact, top, np.searchsorted(term[first], at), blocks[first], block_max)

    def _list(self, t: int) -> tuple[list[int], list[float], list[int], list[float], float]:
        """A term's units, impacts, blocks, their maxima, and its maximum."""
        if t not in self._lists:
            a, b, c, d = self.starts[t], self.starts[t + 1], self.block_starts[t], self.block_starts[t + 1]
            self._lists[t] = (self.units[a:b].tolist(), self.impacts[a:b].tolist(), self.blocks[c:d].tolist(), self.block_max[c:d].tolist(), float(self.top[t]))
        return self._lists[t]

    def wand(self, terms: list[int], threshold: float = THRESHOLD, block: int = BLOCK) -> list[tuple[int, float]]:
        """(unit, score) of all units that get ``threshold`` or more from a passage of these distinct terms."""
        least, found = threshold - 1e-9, []
        # a cursor: [unit, place, units, impacts, blocks, block maxima, maximum]
        cursors = [[x[0][0], 0, *x] for x in map(self._list, terms)]
        while True:
            cursors.sort(key=_unit)
            bound, pivot = 0.0, None
            for pivot, c in enumerate(cursors):
                bound += c[6]
                if bound >= least:
                    break
            else:
                return found
            at = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
                pivot += 1
            here, bound = at // block, 0.0
            for c in cursors[: pivot + 1]:
                k = bisect_left(c[4], here)
                if k < len(c[4]) and c[4][k] == here:
                    bound += c[5][k]
            if bound < least:  # nothing in this block up to the next list's unit
                to = (here + 1) * block
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
            elif cursors[0][0] == at:
                score = sum(c[3][c[1]] for c in cursors[: pivot + 1])
                if score >= least:
                    found.append((at, score))
                to = at + 1
            else:
                to = at
            done = False
            for c in cursors[: pivot + 1]:
                if c[0] < to:
                    c[1] = bisect_left(c[2], to, c[1])
                    c[0] = c[2][c[1]] if c[1] < len(c[2]) else -1
                    done = done or c[0] < 0
            if done:
                cursors = [c for c in cursors if c[0] >= 0]

    def live(self, window: np.ndarray, term: np.ndarray, threshold: float = THRESHOLD, block: int = BLOCK) -> np.ndarray:
        """Of passages with distinct (window, list) pairs of one band, those with a block that may reach ``threshold``.

        A passage's lists are ordered by their maxima. Those that together stay under the threshold, the longest lists
        of common words mostly, name no candidates: only the blocks of the others are read, and what the former can add is added to their bound.
        """
        least, n_blocks, lists = threshold - 1e-9, -(-len(self.ids) // block), len(self.top)
        key = np.sort(window * lists + self._place[term])
        window, term = key // lists, self._by_top[key % lists]
        top = self.top[term]
        total = np.cumsum(top)
        first = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]])) if len(window) else np.zeros(0, np.int64)
        own = np.searchsorted(first, np.arange(len(window)), "right") - 1  # which passage, from 0
        before = total[first] - top[first] if len(first) else total
        rest = total - before[own] < SPARED * least - 1e-7  # sums of long arrays are rounded
        spare = np.bincount(own[rest], top[rest], len(first))
        window, term, own = window[~rest], term[~rest], own[~rest]
        out = [np.zeros(0, np.int64)]
        entries = np.concatenate([[0], np.cumsum(self.block_starts[term + 1] - self.block_starts[term])])
        self.touched += int(entries[-1])
        a = 0
        while a < len(term):  # as many passages at once as have ENTRIES block maxima, one at least
            to = int(np.searchsorted(entries, entries[a] + ENTRIES, "right")) - 1
            b = max(int(np.searchsorted(own, own[min(to, len(term) - 1)])) if to < len(term) else to, int(np.searchsorted(own, own[a], "right")))
            rows, at = _expand(self.block_starts, term[a:b])
            key = own[a:b][rows] * n_blocks + self.blocks[at]
            order = np.argsort(key)
            key = key[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            at_block = key[starts]
            bound = np.add.reduceat(self.block_max[at[order]], starts) + spare[at_block // n_blocks]
            found = np.unique(at_block[bound >= least] // n_blocks)
            out.append(window[np.searchsorted(own, found)])
            a = b
        return np.concatenate(out)

    def retrieve(self, window: np.ndarray, term: np.ndarray, threshold: float = THRESHOLD) -> Iterator[tuple[int, int, float]]:
        """(window, unit, score) of all that reach ``threshold``, from passages' distinct (window, term) pairs, by window."""
        for band in range(BANDS):
            lists = term + band * len(self.terms)
            some = self.starts[lists + 1] > self.starts[lists]
            own, lists = window[some], lists[some]
            live = self.live(own, lists, threshold)
            for w, a, b in zip(live.tolist(), np.searchsorted(own, live).tolist(), np.searchsorted(own, live, "right").tolist(), strict=True):
                for unit, score in self.wand(lists[a:b].tolist(), threshold):
                    yield w, unit, score


def _unit(cursor: list) -> int:
    return cursor[0]


def _expand(starts: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each term its run of entries: (row of ``terms``, place in the entries)."""
    n = starts[terms + 1] - starts[terms]
    rows = np.repeat(np.arange(len(terms)), n)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[terms], n)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, text) in slices of MATCHED_BYTES of text and one text more at most."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)), dtype=np.int64)
        last = np.append(np.flatnonzero(np.diff(ends // MATCHED_BYTES)) + 1, batch.num_rows)
        for a, b in zip([0, *last.tolist()], last.tolist(), strict=False):
            yield batch.slice(a, b - a)


HITS = "__id long, item_id long, score double, question double, answer double, passage long"
_HITS = pa.schema([("__id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64()), ("passage", pa.int64())])


def _query(held, threshold: float, overlap: float):
    half = PASSAGE // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = held.value
        for batch in _slices(batches):
            ids = batch.column(0).to_pylist()
            split = [words_of(x) for x in texts(batch.column(1))]
            docs, pairs, base = [], [], 0
            for d, w in enumerate(split):
                t = np.fromiter(map(index.terms.__getitem__, w), np.int64, len(w))
                at = np.flatnonzero(t >= 0)
                count = max(1, -(-(len(w) - half) // half))  # windows; the last reaches the end
                first = np.minimum(at // half, count - 1)
                before = np.maximum(at // half - 1, 0)
                pairs.append(np.concatenate([first + base, np.minimum(before, count - 1) + base]) * len(index.terms) + np.tile(t[at], 2))
                docs += [(d, k * half) for k in range(count)]
                base += count
            keys = np.unique(np.concatenate(pairs)) if pairs and len(index.terms) else np.zeros(0, np.int64)
            out, known = {}, {}
            for w, i, s in index.retrieve(keys // max(1, len(index.terms)), keys % max(1, len(index.terms)), threshold):
                d, start = docs[w]
                # a long item's parts stand around its unit
                around = index.length[i] if index.length[i] > half else 0
                shares = []
                for part in index.parts[i]:
                    if (w, around, part.size) not in known:
                        known[w, around, part.size] = shingles(split[d][max(0, start - around) : start + PASSAGE + around], part.size)
                    shares.append(len(part.shingles & known[w, around, part.size]) / len(part.shingles) if part.shingles else 1.0)
                item = index.ids[i]
                if min(shares) >= overlap and s > out.get((d, item), (0,))[0]:
                    out[d, item] = (s, *shares, start)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[d] for d, _ in out], pa.int64()), pa.array([i for _, i in out], pa.int64()), *(pa.array([v[k] for v in out.values()], f.type) for k, f in enumerate(list(_HITS)[2:]))], schema=_HITS
            )

    return run


def _clean(held, threshold: float, overlap: float, at: int):
    """Batches without the rows in whose text (column ``at``) an item is found."""
    query = _query(held, threshold, overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(at).cast(pa.string())], names=["__id", "text"])
            keep = np.ones(batch.num_rows, bool)
            for hits in query(iter([own])):
                keep[np.asarray(hits.column(0))] = False
            yield batch.filter(pa.array(keep))

    return run


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole = texts(batch.column(1))
        words = [words_of(x) for x in whole]
        cuts = pa.array([answer_from(x, len(w)) for x, w in zip(whole, words, strict=True)], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(words, pa.list_(pa.binary())), pa.array([units_of(w) if w else [] for w in words], pa.list_(pa.list_(pa.binary()))), cuts], names=["item_id", "g", "words", "units", "cut"])


def _indexes(benchmark: DataFrame) -> Iterator:
    """Broadcast indexes of groups of items; one at least. Null items and items without words take no part."""
    spark = benchmark.sparkSession
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(1, -(-chars // INDEX_CHARS))
    dealt = items.withColumn("g", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)).cast("int"))
    split = materialise(dealt.mapInArrow(_split, "item_id long, g int, words array<binary>, units array<array<binary>>, cut int"), "benchmark")
    units = split.select("g", F.explode("units").alias("u"))
    total = units.agg(F.count("*").alias("n"), F.sum(F.size("u")).alias("words")).first()
    # of all items, for the terms of a group only: neither the items nor their terms meet in one place
    terms = units.select("g", F.explode(F.array_distinct("u")).alias("t"))
    frequency = terms.groupBy("t").agg(F.count("*").alias("n"))
    for g in range(groups):
        # a group holds about INDEX_CHARS characters
        part = split.where(F.col("g") == g).select("item_id", "words", "cut").toLocalIterator()
        held = [(r["item_id"], [bytes(w) for w in r["words"]], r["cut"]) for r in part]
        own = terms.where(F.col("g") == g).select("t").distinct().join(frequency, "t").toLocalIterator()
        known = Statistics(total["n"], (total["words"] or 0) / max(1, total["n"]), {bytes(r["t"]): r["n"] for r in own})
        yield spark.sparkContext.broadcast(Index.build(held, known))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """__id, item_id, score, question, answer, passage: documents and the test items found in them.

    ``docs``: __id, text. score is the passage's BM25 score of the item over the item's own; question and answer are
    the shares of their shingles in the passage that starts at word ``passage`` (the best one; the first of equal
    ones). A question ends at the last question mark or else line feed that words follow, or else after two thirds of the
    words. Of a part of fewer words than a shingle the single words count, in any place; an item of one word has no
    answer. Long texts and long items are read whole. Null and empty texts match nothing; null items and items without words match nothing; of items that
    share an id the best counts. Rows of ``docs`` that share an id each give their own. An empty table on either side gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    out = None
    for held in _indexes(benchmark):
        hits = docs.select("__id", "text").mapInArrow(_query(held, threshold, overlap), HITS)
        out = hits if out is None else out.unionByName(hits)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, passage_start: one row a document and item found in it.

    Rows that share a doc_id, a null one too, are one document, of which the best passage is shown (the later of equal
    ones). Other columns are ignored. Nulls, empty and long texts, and empty tables: as in contaminated.
    """
    keyed = with_key(docs.select("doc_id", F.col("text").cast("string").alias("text")), "doc_id")
    hits = contaminated(keyed, benchmark, threshold, overlap).groupBy("__id", "item_id").agg(F.max(F.struct("score", "question", "answer", "passage")).alias("h"))
    shown = F.when(F.col("__id") != -(2**63), F.col("__id"))
    return hits.select(shown.alias("doc_id"), "item_id", F.round("h.score", 6).alias("score"), F.round("h.question", 6).alias("question_overlap"), F.round("h.answer", 6).alias("answer_overlap"), F.col("h.passage").alias("passage_start"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """``docs`` without the rows in which an item of ``benchmark`` is found; all columns are kept.

    Each row is decided by its own text, whatever rows share its doc_id; null and empty texts stay, repeated rows stay
    or go together. Columns of any name pass through, as fields of a struct. Empty tables: an empty benchmark takes nothing away. One pass over the
    scan for each group of items, without a shuffle.
    """
    bounded_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select("text", F.struct(*(F.col(f"`{c}`").alias(c) for c in rest) if rest else [F.lit(None).alias("none")]).alias("__rest"))
    for held in _indexes(benchmark):
        rows = rows.mapInArrow(_clean(held, threshold, overlap, 0), rows.schema)
    return rows.select(*(F.col("text") if c == "text" else F.col("__rest").getField(c).alias(c) for c in docs.columns))
