"""Phrase collocations against brute force and their SQL, and on odd and empty tables."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faradeon.llm import _shared, collocations
from faradeon.llm.queries import ORACLE_SQL, op12_collocations

SCHEMA = "doc_id long, text string, lang string, w1 string, n int, phrase string, a int, salt int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, "y", 2, 3) for i, t, lang in rows], SCHEMA)


def brute(rows, first=2000, least=10):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(w)
            for m in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[k : k + 2] for p, a in found.items() if len(p) == 3 for k in (0, 1) if 100 * a >= 50 * found[p[k : k + 2]]}
        rows = []
        for p, a in found.items():
            if p not in gone:
                score, _, left, right = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def got(df):
    assert df.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *((c, "bigint") for c in ("a", "l", "r", "n", "score"))]
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(40)] + ["Über", "ÉTÉ", "a　b", "x\x1cy", "\x00", "漢字"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b"]) for _ in range(n))
    out = [(k, text(rng.randrange(1, 400)), rng.choice(["en", "de", None, "und"])) for k in range(120)]
    out += [(200, None, "en"), (201, "", None), (202, " \t\n.", "fr"), (None, "new york city " * 30, "fr"), (204, "A a " * 20_000, "en")] + [(205, "one two three", "es")] * 12
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_collocations_equal_brute_force(spark, rows, parts):
    assert got(collocations.collocations(table(spark, rows).repartition(parts))) == brute(rows)


def test_first_of_each_lang(spark, rows):
    assert got(collocations.collocations(table(spark, rows), first=7, least=3)) == brute(rows, 7, 3)


def test_a_full_filter_changes_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "LARGEST_FILTER", 1 << 15)
    monkeypatch.setattr(collocations.Filter, "holds", lambda self, hashes: np.ones(len(hashes), bool))
    want = brute(rows)
    words = collocations.inverted_lists(table(spark, rows)).collect()
    f = Counter()
    for b in words:
        phrases, n = collocations.grow(b["lang"], b["words"], np.array(b["lengths"]), np.cumsum(np.frombuffer(b["positions"], "<i4")), [collocations.Filter(np.zeros(4096, np.uint8))] * 2)
        for k in range(len(n)):
            f[b["lang"], " ".join(b["words"][p[k]] for p in phrases)] += int(n[k])
    assert all(f[r[0], r[2]] == r[3] for r in want if r[2].count(" ") == 2)


def test_collocations_of_nothing(spark):
    for none in ([], [(1, None, None)], [(1, "a b", "en")] * 9):
        assert got(collocations.collocations(table(spark, none))) == []


def test_collocations_equal_their_sql(spark, tables, rows, tmp_path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet'")
    columns = "lang, rank, phrase, a, l, r, n, score"
    assert got(op12_collocations(spark, tables)) == sorted(con.execute(f"SELECT {columns} FROM ({ORACLE_SQL['op12_collocations']})").fetchall())
    table(spark, rows).write.parquet(str(tmp_path / "d"))
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert brute(rows) == sorted(con.execute(f"SELECT {columns} FROM ({ORACLE_SQL['op12_collocations']})").fetchall())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab .,\n\tA", max_size=30), max_size=5))
def test_lists_are_all_positions(documents):
    words, lengths, positions = collocations.block_of(documents)
    ends = np.cumsum(lengths)
    lists = {w: positions[e - n : e].tolist() for w, n, e in zip(words, lengths, ends)}
    assert all(x == sorted(x) for x in lists.values())
    line = sorted((p, w) for w, x in lists.items() for p in x)
    pieces, before = [], None
    for p, w in line:
        if before is None or p != before + 1:
            pieces.append([])
        pieces[-1].append(w)
        before = p
    assert pieces == [w for d in documents for piece in re.split("[.,\n]", d.lower()) if (w := piece.split())]


def test_filter_holds_all_that_it_was_built_of(spark):
    df = spark.createDataFrame([("en", f"wört{k}", f"b{k % 7}") for k in range(5000)], "lang string, w1 string, w2 string")
    held = collocations.Filter.of(df, ["w1", "w2"])
    a, b = (collocations._hashes("en", [r[c] for r in df.collect()]) for c in ("w1", "w2"))
    assert held.holds((a << np.uint64(1)) ^ b).all()
    other = collocations._hashes("de", [f"x{k}" for k in range(5000)])
    assert held.holds(other).mean() < 0.15


def test_a_task_holds_little_of_what_it_stores_and_reads(spark, monkeypatch):
    """Rows of blocks are large: 24 of a megabyte are neither written as one row group nor read by one task."""
    seen = {}

    class Stop(Exception):
        pass

    def keep(df, label, *options):
        if label != "positions":
            seen["tasks"] = seen["positions"].rdd.getNumPartitions()
            raise Stop
        seen[label] = _shared.materialise(df, label, *options)
        return seen[label]

    monkeypatch.setattr(collocations, "materialise", keep)
    docs = spark.range(0, 24, 1, 1).selectExpr("string(id) AS lang", "array_join(transform(sequence(1, 200000), x -> concat('w', pmod(xxhash64(x, id), 30000))), ' ') AS text")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        with pytest.raises(Stop):
            collocations.collocations(docs)
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    (file,) = seen["positions"].inputFiles()
    stored = pq.ParquetFile(file.removeprefix("file://")).metadata
    assert stored.num_rows == 24
    assert max(stored.row_group(k).total_byte_size for k in range(stored.num_row_groups)) < 16 << 20
    assert seen["tasks"] >= 3
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_small_splits_leave_smaller_ones(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        for now, most, inside in (("1m", 8 << 20, "1m"), ("16m", 8 << 20, str(8 << 20)), ("134217728b", 1 << 20, str(1 << 20))):
            spark.conf.set(key, now)
            with _shared.small_splits(spark, most):
                assert spark.conf.get(key) == inside
            assert spark.conf.get(key) == now
    finally:
        spark.conf.set(key, before)
