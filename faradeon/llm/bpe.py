"""Byte-level BPE encoding and decoding with a transducer of frequent words.

A text is cut before single spaces and line feeds that stand between other characters, where the pattern of byte-level
BPE never joins characters, so each unit is encoded by itself. Words (units without the marks at their end) are counted
over all documents; those that occur most, with their ids, are compiled into a minimal acyclic transducer, written to
the shared folder and handed to the executors by Spark, where workers memory-map it. A batch's distinct units are looked
up together, then the words of units that aren't there; what is left is cut by the library's pre-tokeniser and merged
here, by rank, exactly. So the lexicon decides the speed and never the ids.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import bounded_batches, materialise, own_path, temporary, texts
from .lexicon import Lexicon, compiled
from .tokenize import _RARE, _SEGMENT, WHITE, _byte_letters, vocabulary

#: Words in the lexicon at most, their least count, and their longest size in bytes; they bound memory only.
UNITS, LEAST, LONGEST = 1 << 18, 3, 48
#: Runs of marks that a worker keeps, and words that are merged at once.
KEPT, MERGED = 100_000, 1 << 14
#: Marks that never join the letters before them; the apostrophe can.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A word and the marks at its end. Letters of scripts whose list of letters is long closed; others go to the pre-tokeniser.
_MARKED = re.compile(r"([ \n]?)([A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0386\u0388-\u038a\u038c\u038e-\u03a1\u03a3-\u03f5\u0400-\u0481]+)([!-&(-/:-@\[-`{-~]*)")
#: Bytes of texts that are encoded at once; they bound memory only.
SLICE_BYTES = 4 << 20
#: Symbols from which pairs stand in a heap.
HEAP_FROM = 40
_NONE = 1 << 62

ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


class Bpe:
    """The vocabulary of a file: exact merges of a unit, and the bytes of each id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, added = told["model"], told["added_tokens"]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if told["normalizer"] or told["pre_tokenizer"]["type"] != "ByteLevel" or told["pre_tokenizer"]["add_prefix_space"] or not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("only byte-level BPE without normalisation is supported")
        vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in added}
        self._special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self._letters = vocab
        self._pairs = {}  # (left, right): rank * 2^24 + the joined id
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self._pairs[vocab[a], vocab[b]] = rank << 24 | vocab[a + b]
        left, right = np.array([*self._pairs], np.int64).reshape(-1, 2).T
        order = np.argsort(left << 24 | right)
        self._keys, self._values = (left << 24 | right)[order], np.array([*self._pairs.values()], np.int64)[order]
        shown = _byte_letters()
        self._of_byte = np.array([vocab[shown[b]] for b in range(256)], np.int64)
        self._cut = Tokenizer.from_file(path).pre_tokenizer
        back = {letter: byte for byte, letter in _byte_letters().items()}
        self.bytes = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in [*vocab.items(), *self.specials.items()]}
        self._ends: dict[str, list[int]] = {}
        self.feed = self.unit("\n")

    def merge(self, letters: str) -> list[int]:
        """Ids of one word, given as byte letters: the pair of least rank is joined first, the leftmost of equal ones."""
        ids = [self._letters[c] for c in letters]
        if len(ids) >= HEAP_FROM:
            return self._merge_long(ids)
        known = self._pairs.get
        pairs = [known(p, _NONE) for p in zip(ids, ids[1:], strict=False)]
        while pairs and (least := min(pairs)) < _NONE:
            i, new = pairs.index(least), least & 0xFFFFFF
            ids[i : i + 2] = [new]
            del pairs[i]
            if i:
                pairs[i - 1] = known((ids[i - 1], new), _NONE)
            if i < len(pairs):
                pairs[i] = known((new, ids[i + 1]), _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap of pairs over linked symbols."""
        n, known = len(ids), self._pairs
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(found, i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := known.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            found, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been joined to another
            ids[i], ids[j] = found & 0xFFFFFF, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (found := known.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (found, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and joined id of pairs of ids, _NONE where they don't join; negative ids join nothing."""
        key = left << 24 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (left >= 0) & (right >= 0), self._values[at], _NONE)

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of many words, each of letters alone after a space or nothing: a step joins one pair of every word."""
        data = [w.encode("utf-8") for w in words]
        size = np.fromiter(map(len, data), np.int64, len(data))
        out: list[list[int]] = [[]] * len(data)
        for k in np.flatnonzero(size >= HEAP_FROM).tolist():
            out[k] = self._merge_long(self._of_byte[np.frombuffer(data[k], np.uint8)].tolist())
        own = np.flatnonzero(size < HEAP_FROM)
        own = own[np.argsort(size[own], kind="stable")]
        for part in np.array_split(own, -(-len(own) // MERGED)) if len(own) else ():  # of like lengths
            n = size[part]
            at = np.arange(int(n[-1])) < n[:, None]
            ids = np.full(at.shape, -1, np.int64)
            ids[at] = self._of_byte[np.frombuffer(b"".join(data[k] for k in part.tolist()), np.uint8)]
            for k, x, m in zip(part.tolist(), *self._joined(ids, n), strict=True):
                out[k] = x[:m]
        return out

    def _joined(self, ids: np.ndarray, n: np.ndarray) -> tuple[list[list[int]], list[int]]:
        n, width = n.copy(), ids.shape[1]
        edge = np.full((len(ids), 1), _NONE)
        rank = np.concatenate([self._ranks(ids[:, :-1], ids[:, 1:]), edge], 1)
        active, place = np.arange(len(ids)), np.arange(width)
        while True:
            least = rank[active].argmin(1)
            value = rank[active, least]
            go = value < _NONE
            active, least, value = active[go], least[go], value[go]
            if not len(active):
                return ids.tolist(), n.tolist()
            # what stands right of the pair moves a place to the left
            moved = np.minimum(place + (place > least[:, None]), width - 1)
            own, ranks = np.take_along_axis(ids[active], moved, 1), np.take_along_axis(rank[active], np.minimum(place + (place >= least[:, None]), width - 1), 1)
            own[:, -1], ranks[:, -1] = -1, _NONE
            rows = np.arange(len(active))
            own[rows, least] = value & 0xFFFFFF
            after = np.where(least + 1 < width, own[rows, np.minimum(least + 1, width - 1)], -1)
            ranks[rows, least] = self._ranks(own[rows, least], after)
            some = least > 0
            ranks[rows[some], least[some] - 1] = self._ranks(own[rows[some], least[some] - 1], own[rows[some], least[some]])
            ids[active], rank[active] = own, ranks
            n[active] -= 1

    def unit(self, text: str) -> list[int]:
        """Ids of any unit."""
        return [i for letters, _ in self._cut.pre_tokenize_str(text) for i in self.merge(letters)]

    def marks(self, text: str) -> list[int]:
        """Ids of marks that follow a word."""
        ids = self._ends.get(text)
        if ids is None:
            if len(self._ends) >= KEPT:
                self._ends.clear()
            ids = self._ends[text] = self.unit(text) if text else []
        return ids

    def marked(self, text: str) -> bool:
        """Whether a special token's string is in it."""
        return any(s in text for s in self.specials)

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Pieces of a text and whether they are special tokens."""
        at = 0
        for m in self._special.finditer(text):
            if m.start() > at:
                yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def decode(self, ids: list[int]) -> str:
        """Text of ids, as the library gives it; numbers that are no ids have none."""
        return b"".join([self.bytes.get(i, b"") for i in ids]).decode("utf-8", "replace")


class _Spaced(dict):
    """Numbers of units that follow a space, or begin with a line feed."""

    def __init__(self, units: list[str]):
        self.units = units

    def __missing__(self, piece: str) -> int:
        self[piece] = code = len(self.units)
        self.units.append(piece if piece[0] == "\n" else " " + piece)
        return code


class _Plain(dict):
    """Numbers of units as they stand."""

    def __init__(self, units: list[str]):
        self.units = units

    def __missing__(self, unit: str) -> int:
        self[unit] = code = len(self.units)
        self.units.append(unit)
        return code


def _units(text: str, spaced: _Spaced, plain: _Plain) -> list[int]:
    if "  " in text or "\n " in text or " \n" in text or "\n\n" in text or text[-1] in WHITE or text[0] in WHITE or any(c in text for c in _RARE):
        return [plain[x] for x in _SEGMENT.findall(text)]
    head, *rest = text.replace("\n", " \n").split(" ")
    return [plain[head], *map(spaced.__getitem__, rest)]


def find(lexicon: Lexicon, units: list[str]) -> np.ndarray:
    """Places in the lexicon; -1 where a unit isn't there or is longer than what is."""
    return lexicon.find([u.encode("utf-8") if len(u) <= LONGEST else b"" for u in units]) if units else np.zeros(0, np.int64)


def _unseen(bpe: Bpe, lexicon: Lexicon, units: list[str]) -> list[list[int]]:
    """Ids of units that the lexicon lacks: of a word in it and the marks after the word, or merged."""
    split = [_MARKED.fullmatch(u) for u in units]
    words = list({m[1].replace("\n", "") + m[2] for m in split if m and (m[3] or m[1] == "\n")})
    ids, ends = lexicon.ids, lexicon.ends
    known = {w: ids[ends[p] : ends[p + 1]].tolist() for w, p in zip(words, find(lexicon, words).tolist(), strict=True) if p >= 0}
    rest = list({w for m in split if m and (w := m[1].replace("\n", "") + m[2]) not in known})
    known |= zip(rest, bpe.words(rest), strict=True)
    out = []
    for u, m in zip(units, split, strict=True):
        if m:
            feed = m[1] == "\n"
            found = known[m[2] if feed else m[1] + m[2]]
            out.append([*(bpe.feed if feed else ()), *found, *bpe.marks(m[3])] if feed or m[3] else found)
        else:
            out.append([bpe.specials[u]] if u in bpe.specials else bpe.unit(u))
    return out


def encode_batch(bpe: Bpe, lexicon: Lexicon, documents: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the documents in turn, and where each document's begin (one more than documents)."""
    units: list[str] = []
    spaced, plain = _Spaced(units), _Plain(units)
    codes = []
    for text in documents:
        if bpe.marked(text):
            own = [c for part, special in bpe.parts(text) for c in ([plain[part]] if special else _units(part, spaced, plain))]
        else:
            own = _units(text, spaced, plain) if text else []
        codes.append(np.array(own, np.int64))
    places = find(lexicon, units)
    unseen = np.flatnonzero(places < 0).tolist()
    merged = _unseen(bpe, lexicon, [units[k] for k in unseen])
    known = places >= 0
    # each unit's run of ids: in the lexicon, or behind it
    starts, sizes = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
    ends = lexicon.ends.astype(np.int64)
    starts[known], sizes[known] = ends[places[known]], ends[places[known] + 1] - ends[places[known]]
    own = np.array([len(x) for x in merged], np.int64)
    sizes[unseen], starts[unseen] = own, np.cumsum(own) - own + len(lexicon.ids)
    table = np.concatenate([lexicon.ids.astype(np.int32), np.array([i for x in merged for i in x], np.int32)])
    line = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    n = sizes[line]
    ids = table[np.repeat(starts[line] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    before = np.concatenate([[0], np.cumsum(n)])
    return ids, before[np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int64)]


_HELD: dict[str, object] = {}


def _bpe(path: str) -> Bpe:
    """One for each worker process and vocabulary file."""
    if path not in _HELD:
        _HELD[path] = Bpe(path)
    return _HELD[path]


def _lexicon(name: str) -> Lexicon:
    if name not in _HELD:
        _HELD[name] = Lexicon.map(SparkFiles.get(name))
    return _HELD[name]


def frequent_units(docs: DataFrame, most: int = UNITS, least: int = LEAST) -> DataFrame:
    """unit, count: the words of all of ``docs`` (cut at white space and marks), each with a space before it, with the largest counts, ``most`` of them at most; all of a count or none.

    Where to cut is read off a histogram of counts (eight bins an octave), so nothing is sorted in one task.
    """
    marks = MARKS + "\n"
    piece = F.explode(F.split(F.translate(F.col("text").cast("string"), marks, " " * len(marks)), " ", -1))
    word = docs.select(piece.alias("p")).where((F.col("p") != "") & (F.octet_length("p") < LONGEST))
    counts = word.groupBy("p").agg(F.count("*").alias("count")).where(F.col("count") >= least).select(F.concat(F.lit(" "), "p").alias("unit"), "count", F.floor(F.log2("count") * 8).cast("int").alias("bin"))
    counts = materialise(counts, "units")
    cut, held = 0, 0
    for r in counts.groupBy("bin").agg(F.count("*").alias("n")).orderBy(F.desc("bin")).collect():  # at most 8 bins for each of 63 octaves
        held += r["n"]
        if held > most:
            cut = r["bin"] + 1
            break
    return counts.where(F.col("bin") >= cut).select("unit", "count")


def _with_ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches:
            units = batch.column(0)
            # a special token in a unit is the token itself, which texts are cut at before
            ids = [None if bpe.marked(u) else bpe.unit(u) for u in units.to_pylist()]
            yield pa.RecordBatch.from_arrays([units, pa.array(ids, pa.list_(pa.int32()))], names=["unit", "ids"])

    return run


def build_lexicon(docs: DataFrame, path: str, most: int = UNITS, least: int = LEAST) -> str:
    """Compiles the frequent units of ``docs`` and hands the file to all executors; its name there.

    The lexicon has ``most`` units at most, of LONGEST bytes at most, so it is compiled on the driver.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = frequent_units(docs, most, least).select("unit").mapInArrow(_with_ids(path), "unit string, ids array<int>").where("ids is not null")
    data = compiled([(r["unit"].encode("utf-8"), r["ids"]) for r in rows.toLocalIterator()])
    out = f"{own_path(spark, 'lexicon')}.bin"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    stream.write(data)
    stream.close()
    temporary(spark, out)
    spark.sparkContext.addFile(out)
    return out.rpartition("/")[2]


def _encode(path: str, name: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, lexicon = _bpe(path), _lexicon(name)
        for whole in batches:
            for batch in _slices(whole):
                ids, starts = encode_batch(bpe, lexicon, texts(batch.column(1)))
                columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))]
                if decoded:
                    columns.append(pa.array([bpe.decode(ids[a:b].tolist()) for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "text"][: len(columns)])

    return run


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, about SLICE_BYTES of text at once, one row at least."""
    size = np.cumsum(np.asarray(pc.binary_length(batch.column(1).fill_null("")), np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + SLICE_BYTES, "right")))
        yield batch.slice(a, b - a)
        a = b


def _rows(docs: DataFrame, path: str, name: str | None) -> tuple[DataFrame, str]:
    name = name or build_lexicon(docs, path)
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), name


def encode(docs: DataFrame, path: str | None = None, name: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>): every whole text of ``docs`` (doc_id, text) encoded as the tokenizers library does by default.

    Null text is empty and has no ids; null and repeated doc_ids, ties and repeated rows are rows like any other; texts
    may have any length; other columns are ignored; an empty table gives no rows. The strings of special tokens in a
    text are those tokens. ``name``: a lexicon from build_lexicon, else one is built from ``docs``.
    """
    path = path or vocabulary()
    rows, name = _rows(docs, path, name)
    return rows.mapInArrow(_encode(path, name, False), "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str | None = None, name: str | None = None) -> DataFrame:
    """doc_id, ids, text: ``encode`` and then ``decode`` of each document's ids, in the same tasks."""
    path = path or vocabulary()
    rows, name = _rows(docs, path, name)
    return rows.mapInArrow(_encode(path, name, True), "doc_id long, ids array<int>, text string")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches:
            column = batch.column(1)
            found = [bpe.decode(x.values.to_pylist()) if x.is_valid else None for x in column]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["doc_id", "ids", "text"])

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, text: the text of each row's ids, special tokens by their strings, as the library's decode gives it.

    Bytes that are no UTF-8 become U+FFFD; numbers that are no ids, null ones too, give nothing; null ids have null text.
    """
    bounded_batches(encoded.sparkSession)
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decode(path or vocabulary()), "doc_id long, ids array<int>, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of decoded rows."""
    decimal = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def read_lexicon(spark: SparkSession, name: str) -> Lexicon:
    """The lexicon of that name, mapped on the driver."""
    return Lexicon.map(SparkFiles.get(name))
