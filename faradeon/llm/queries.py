"""Queries over the driver's tables for the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, decontaminate, html_text, language_id, line_dedup, near_dup, packing, quality, sharding, token_output, topk, whitening
from ._shared import read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_recurring_lines(read(spark, sf_dir, "documents")).select("doc_id", "text", "lines_dropped")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(read(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stratified_shards(read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read(spark, sf_dir, "pages"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(read(spark, sf_dir, "documents")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_best_fit_packing, op3_language_id, op4_near_dedup, op5_sharding, op6_decontamination, op7_token_output, op8_quality, op9_html_text, op10_top_k, op11_bpe, op12_collocations, op13_whitening)}

_LINE_DEDUP = r"""
WITH distinct_lines AS (
  SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents
), masked AS (
  SELECT doc_id, l, regexp_replace(translate(l, chr(9) || chr(13), '  '), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS m FROM distinct_lines WHERE trim(translate(l, chr(9) || chr(13), '  ')) <> ''
), lines AS (
  SELECT doc_id, l, string_split(regexp_replace(m, '([^ ]{16})', '\1 ', 'g'), ' ') AS t FROM masked
), cut AS (
  SELECT doc_id, l, t, len(t) AS n, [CAST(floor(greatest(len(t) - 2, 0) * j / 5.0) AS INT) FOR j IN range(6)] AS c FROM lines
), parts AS (
  SELECT doc_id, l, t, n, list_slice(t, 1, 2) AS head, [list_slice(t, c[j] + 3, c[j + 1] + 2) FOR j IN range(1, 6)] AS runs FROM cut
), keys AS (
  SELECT doc_id, l, n, head, CASE WHEN v.w = 0 THEN runs ELSE [CASE WHEN j = v.w THEN ['<run>', NULL] ELSE runs[j] END FOR j IN range(1, 6)] END AS template, v.w AS w,
    len([x FOR x IN t IF x <> '<*>']) - CASE WHEN v.w = 0 THEN 0 ELSE len([x FOR x IN runs[v.w] IF x <> '<*>']) END AS fixed
  FROM parts CROSS JOIN (SELECT unnest(range(6)) AS w) v WHERE v.w = 0 OR n >= 7
), recurring AS (
  SELECT n, head, template, w, min(doc_id) AS first FROM keys GROUP BY n, head, template, w, fixed
  HAVING min(doc_id) < max(doc_id) AND count(DISTINCT doc_id) >= 2 AND fixed > 0 AND (w = 0 OR count(DISTINCT doc_id) * fixed >= 16)
), dropped AS (
  SELECT DISTINCT k.doc_id, k.l FROM keys k JOIN recurring r ON k.n = r.n AND k.head = r.head AND k.template = r.template AND k.w = r.w WHERE k.doc_id > r.first
), placed AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS at FROM documents
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(p.text, '') END AS text, coalesce(p.lines_dropped, 0) AS lines_dropped FROM documents d LEFT JOIN (
  SELECT p.doc_id, string_agg(p.l, chr(10) ORDER BY p.at) FILTER (WHERE d.l IS NULL) AS text, CAST(count(d.l) AS BIGINT) AS lines_dropped
  FROM placed p LEFT JOIN dropped d ON p.doc_id = d.doc_id AND p.l = d.l GROUP BY p.doc_id
) p ON d.doc_id = p.doc_id
"""

_TOP_K = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.row <> c.row
)
SELECT query_id, CAST(r AS INT) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 20
"""

_NEAR_DEDUP = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS s FROM split
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.r = edges.a
), roots AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN roots USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

_COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, m, unnest([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, len(w) - m + 2)]) AS phrase FROM split CROSS JOIN (SELECT unnest(range(1, 4)) AS m)
), f AS (
  SELECT lang, m, phrase, count(*) AS n FROM grams GROUP BY ALL
), candidates AS (
  SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND n >= 10
), cuts AS (
  SELECT lang, m, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:m], ' ') AS rest FROM candidates CROSS JOIN (SELECT unnest([1, 2]) AS k) WHERE k < m
), scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, k, x.n AS l, y.n AS r, CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.rest
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored
), covered AS (
  SELECT DISTINCT s.lang, s.phrase FROM candidates s JOIN candidates t ON s.lang = t.lang AND s.m = 2 AND t.m = 3 AND (s.w = t.w[1:2] OR s.w = t.w[2:3]) AND 100 * t.a >= 50 * s.a
), ranked AS (
  SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest ANTI JOIN covered USING (lang, phrase) WHERE place = 1
)
SELECT lang, rank, phrase, a, l, r, CAST((SELECT sum(n) FROM f WHERE f.lang = ranked.lang AND m = 1) AS BIGINT) AS n, score FROM ranked WHERE rank <= 2000
"""

#: The table of CRC-32 by its rule: eight steps of the reflected polynomial.
_CRC = [functools.reduce(lambda c, _: (c >> 1) ^ (0xEDB88320 * (c & 1)), range(8), k) for k in range(256)]

_SHARDING = f"""
WITH docs AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS s, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
    xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], [CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex(coalesce(text, '')), '..')]),
      lambda c, b: xor(list_extract(CAST({_CRC} AS BIGINT[]), (xor(c, b) & 255) + 1), c >> 8))) AS text_crc32,
    CAST('0x' || substr(md5(concat_ws(':', '{sharding.SEED}', doc_id)), 1, 15) AS BIGINT) AS h
  FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, doc_id NULLS FIRST, text_crc32, size) AS r, count(*) OVER (PARTITION BY s) AS n,
    CAST('0x' || substr(md5('{sharding.SEED}:' || s), 1, 5) AS BIGINT) / CAST(1048576 AS DOUBLE) AS phase
  FROM docs
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (r - phase) / n, s, h, doc_id NULLS FIRST, text_crc32, size) - 1 AS p, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, size, text_crc32, source, 'rows' AS law, CAST(p * 8 // total AS INT) AS shard, p - (p * 8 // total * total + 7) // 8 AS slot, CAST(NULL AS INT) AS grown_shard FROM placed
"""

ORACLE_SQL = {"op1_line_dedup": _LINE_DEDUP, "op4_near_dedup": _NEAR_DEDUP, "op5_sharding": _SHARDING, "op10_top_k": _TOP_K, "op12_collocations": _COLLOCATIONS}
