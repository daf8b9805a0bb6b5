"""BPE by a transducer of frequent words against the tokenizers library, and on odd and empty tables."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faradeon.llm import bpe, lexicon
from faradeon.llm.queries import op11_bpe
from faradeon.llm.tokenize import vocabulary

SCHEMA = "doc_id long, text string, ids string, unit string, p int, count int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", 1, 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(vocabulary())


def digest(library, doc_id, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def order(rows):
    return sorted(rows, key=repr)


ODD = ["", " ", "\n", "  lead", "trail  ", "a\n\nb", "a \n b", "it's we'll I'D", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>\n", "<|endoftext", "é 漢字 한국어 🙂👩‍👩‍👧", "a　b\xa0c\x85d", "\x00\x01", "123 4567 ½ ²", "Ünï çødé", "...!!! ?? --", "a\tb\r\nc", "\n \n", "word" * 3000, "x" * 50_000, " " * 9000, " z\x1cy"]


def test_odd_texts_in_one_table(spark, library, monkeypatch):
    rng = random.Random(4)
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, None), (None, "no id"), (7, "again"), (7, "again"), (8, "the word the word " * 20_000)]
    rows += [(100 + k, " ".join(rng.choice(["the", "of", "Wörter,", "naïve.", "end.\nNext", f"n{k}", "don't"]) for _ in range(rng.randrange(90)))) for k in range(120)]
    monkeypatch.setattr(bpe, "SLICE_BYTES", 5000)
    df = bpe.digests(bpe.round_trip(table(spark, rows)))
    assert order(map(tuple, bpe.digests(bpe.decode(bpe.encode(table(spark, rows)))).collect())) == order(map(tuple, df.collect()))
    assert df.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert order(map(tuple, df.collect())) == order(digest(library, i, t) for i, t in rows)


def test_documents(spark, tables, library):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    assert order(map(tuple, op11_bpe(spark, tables).collect())) == order(digest(library, i, t) for i, t in rows)


def test_empty_table_and_no_frequent_word(spark, library):
    df = bpe.digests(bpe.decode(bpe.encode(table(spark, []))))
    assert df.collect() == [] and df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert [tuple(r) for r in bpe.digests(bpe.decode(bpe.encode(table(spark, [(1, "just once")])))).collect()] == [digest(library, 1, "just once")]


def test_lexicon_holds_the_most_frequent_units_of_all_documents(spark):
    df = table(spark, [(k, "often often rare " + f"u{k}") for k in range(40)] + [(99, "x often\nline " * 5)])
    assert {(r["unit"], r["count"]) for r in bpe.frequent_units(df, 5, 3).collect()} == {(" often", 85), (" rare", 40), (" line", 5), (" x", 5)}
    held = bpe.read_lexicon(spark, bpe.build_lexicon(df, vocabulary()))
    assert (held.find([b" often", b" rare", b" line"]) >= 0).all() and held.find([b" u7"])[0] == -1
    few = {r["unit"] for r in bpe.frequent_units(df, 2, 3).collect()}
    assert " often" in few and len(few) <= 2


def test_decode_of_any_ids(spark, library):
    ids = [[50256, 13, 198], [255, 128], [], [10**6, 464], None, [464, None, 11]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(ids)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in bpe.decode(df).collect()}
    for k in range(4):
        assert got[k] == library.decode(ids[k], skip_special_tokens=False)
    assert got[4] is None and got[5] == library.decode([464, 11], skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t\r '1.!<|endoftext|> 　漢Zs", max_size=60), max_size=4))
def test_batches_equal_the_library(documents):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(vocabulary()) if not _KEEP else _KEEP[0], _KEEP[1] if _KEEP else bpe.Bpe(vocabulary())
    _KEEP[:] = [library, own]
    units = [" a", " b", "\na", "é", " ab", " end", "  a"]
    held = lexicon.Lexicon(lexicon.compiled([(u.encode(), own.unit(u)) for u in units]))
    ids, starts = bpe.encode_batch(own, held, documents)
    want = [library.encode(t, add_special_tokens=False).ids for t in documents]
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == want
    assert [own.decode(x) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]


_KEEP: list = []


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_merges_equal_the_library(text):
    from tokenizers import Tokenizer

    _KEEP[:] = _KEEP or [Tokenizer.from_file(vocabulary()), bpe.Bpe(vocabulary())]
    assert _KEEP[1].unit(text) == _KEEP[0].encode(text, add_special_tokens=False).ids if not _KEEP[1].marked(text) else True


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abcdeinrstégЖ", max_size=14) | st.text(alphabet="ab", min_size=40, max_size=70), max_size=30), st.integers(1, 9))
def test_words_merged_at_once_equal_the_library(words, at_once):
    from tokenizers import Tokenizer

    _KEEP[:] = _KEEP or [Tokenizer.from_file(vocabulary()), bpe.Bpe(vocabulary())]
    before, bpe.MERGED = bpe.MERGED, at_once
    try:
        spaced = [w if k % 2 else " " + w for k, w in enumerate(words)]
        assert _KEEP[1].words(spaced) == [_KEEP[0].encode(w, add_special_tokens=False).ids for w in spaced]
    finally:
        bpe.MERGED = before


@settings(max_examples=200, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=30), st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=30))
def test_transducer(words, others):
    words = sorted(words)
    held = lexicon.Lexicon(lexicon.compiled([(w, list(range(k % 4))) for k, w in enumerate(words)]))
    assert held.find(words).tolist() == list(range(len(words))) if words else True
    assert held.find(others).tolist() == [words.index(w) if w in words else -1 for w in others] if others else True
    assert all(held.ids[held.ends[k] : held.ends[k + 1]].tolist() == list(range(k % 4)) for k in range(len(words)))
    # least: as many states as there are different sets of endings
    endings = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)} | {b""}}
    assert len(held.final) == len(endings)


def test_shared_endings_are_stored_once():
    words = sorted({f"{a}{b}ations".encode() for a in "bcdfgh" for b in "aeiou"})
    states, _ = lexicon.automaton(words)
    assert len(states) == 3 + len("ations")
