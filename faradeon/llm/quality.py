"""Quality classifier with hierarchical empirical Bayes.

A logistic model of a document's words, word beginnings and style gives its own evidence. Expected counts of good
documents are summed by site and by path of a site (grouped sums over all documents); each level's rate is
shrunk towards the level above it, the more the fewer documents it has, with strengths estimated from the
spread of the rates around the level above. A document's posterior joins its own evidence with the rate of its path,
which, like that of its site, is taken without the document itself.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import bounded_batches, materialise, texts

#: Labelled documents to learn from: so many of each kind (low quality, toxic, neither), and the sum of their bytes.
SAMPLE, SAMPLE_BYTES = 1200, 8 << 20
#: Documents of the sample that must have a feature, and its least z-score.
LEAST_DF, LEAST_Z = 5, 3.5
#: Beginnings of words that are features, in bytes.
BEGINNINGS = (4, 5, 6)
CACHE_WORDS = 300_000
THRESHOLD = 0.5
TARGETS = ("quality", "toxic")
_ENDS = re.compile(rb"[!-/:-@\[-`{-~]{2,}$")


def features(word: bytes) -> list[bytes]:
    w = word.lower().strip(b".,;:!?\"'()")
    return [w, *(w[:k] + b"*" for k in BEGINNINGS if len(w) >= k)]


def style(words: list[bytes], text: bytes) -> np.ndarray:
    """Shares: repeated neighbours, distinct words, pipes, upper-case words, words that end in symbols; word length; log words."""
    n = max(1, len(words))
    return np.array([
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(set(words)) / n ** 0.8, words.count(b"|") / n,
        sum(map(bytes.isupper, words)) / n, sum(1 for w in words if w[-1] < 65 and _ENDS.search(w)) / n, min(len(text) / n, 50) / 10, np.log1p(n) / 10,
    ])


@dataclass
class Model:
    weights: dict[bytes, float]
    style: np.ndarray
    bias: float
    prior: float  # logit of the share of ones in the sample

    def logit(self, words: list[bytes], own: np.ndarray, cache: dict[bytes, float]) -> float:
        return float(own @ self.style) + self.bias + sum(map(cache.__getitem__, set(words)))


class _Weights(dict):
    """Summed weights of words; bounded."""

    def __init__(self, weights: dict[bytes, float]):
        super().__init__()
        self._weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        w = self[word] = sum(self._weights.get(f, 0.0) for f in set(features(word)))
        return w


def _present(text: str) -> set[bytes]:
    return {f for w in set(text.encode("utf-8", "surrogatepass").split()) for f in features(w)}


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def train(rows: list[tuple[str, int]], l2: float = 1.0, steps: int = 300) -> Model:
    """Logistic regression on features that tell the classes apart by z-score, and on style."""
    y = np.array([r[1] for r in rows], np.float64)
    prior = _logit((y.sum() + 1) / (len(y) + 2))
    if not len(y) or y.min() == y.max():
        return Model({}, np.zeros(7), prior, prior)
    df: tuple[Counter, Counter] = (Counter(), Counter())
    for text, k in rows:  # twice over the sample rather than all its features in memory
        df[k].update(_present(text))
    n = [(y == 0).sum(), (y == 1).sum()]
    chosen = []
    for f in df[0].keys() | df[1].keys():
        a, b = df[0][f], df[1][f]
        if a + b >= LEAST_DF:
            share = (a + b) / len(y)
            if abs(a / n[0] - b / n[1]) >= LEAST_Z * np.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1])):
                chosen.append(f)
    chosen.sort()
    at = {f: k for k, f in enumerate(chosen)}
    row, col, own = array("q"), array("q"), []
    for i, (text, _) in enumerate(rows):
        own_at = [at[f] for f in _present(text) if f in at]
        row.extend([i] * len(own_at))
        col.extend(own_at)
        data = text.encode("utf-8", "surrogatepass")
        own.append(style(data.split(), data))
    row, col, own = np.array(row, np.int64), np.array(col, np.int64), np.array(own)
    mean, spread = own.mean(0), own.std(0) + 1e-6
    own = (own - mean) / spread
    w, s, b = np.zeros(len(chosen)), np.zeros(own.shape[1]), prior
    gw, gs, gb = np.full(len(w), 1e-6), np.full(len(s), 1e-6), 1e-6
    for _ in range(steps):  # AdaGrad on the whole sample
        z = np.bincount(row, w[col], len(y)) + own @ s + b
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        dw, ds, db = np.bincount(col, e[row], len(w)) + l2 * w / len(y), own.T @ e, e.sum()
        gw, gs, gb = gw + dw**2, gs + ds**2, gb + db**2
        w, s, b = w - 0.3 * dw / np.sqrt(gw), s - 0.3 * ds / np.sqrt(gs), b - 0.3 * db / np.sqrt(gb)
    return Model(dict(zip(chosen, w.tolist(), strict=True)), s / spread, b - float((s * mean / spread).sum()), prior)


def sample(docs: DataFrame, labels: DataFrame, each: int = SAMPLE, most: int = SAMPLE_BYTES) -> list[tuple[str, int | None, int | None]]:
    """(text, quality, toxic) of up to ``each`` labelled documents of each kind, the first in the order of a hash of doc_id.

    They have ``most`` bytes a kind in all; a text that is longer alone comes after all others and is cut to that, so
    it is learned from only where its kind has no other. Of labels that share a doc_id the least quality and
    the greatest toxic count.
    """
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    size = F.octet_length("text")
    sizes = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("t"), F.when(size > most, most).otherwise(size).cast("long").alias("size"), (size > most).alias("long")).join(known, "doc_id")
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) == 1
    few, order = None, [F.col("long"), F.xxhash64("doc_id"), F.col("doc_id"), F.col("t")]
    for kind in (toxic, (F.col("quality") == 0) & ~toxic, (F.coalesce(F.col("quality"), F.lit(1)) == 1) & ~toxic):
        part = sizes.where(kind).orderBy(*order).limit(each)
        # `each` rows
        at = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        part = part.withColumn("sum", F.sum("size").over(at)).withColumn("r", F.count("*").over(at)).where((F.col("sum") <= most) | (F.col("r") == 1))
        few = part if few is None else few.unionByName(part)
    few = materialise(few.select("doc_id", "t", "quality", "toxic").distinct(), "label-sample")  # 3 * each rows
    rows = docs.withColumn("t", F.xxhash64("text")).select("doc_id", "t", "text").join(F.broadcast(few), ["doc_id", "t"]).select("doc_id", F.substring("text", 1, most).alias("text"), "quality", "toxic").distinct()
    return [(r["text"], r["quality"], r["toxic"]) for r in rows.orderBy("doc_id", "text").toLocalIterator()]


def _strength(groups: DataFrame, rate: Column, n: Column, above: Column, n_above: Column) -> float:
    """Documents that the prior of a level is worth, by the moments of its groups' rates around those of the level above."""
    within = above * (1 - above)
    rest = 1 - n / n_above  # a group's part in the rate above it doesn't tell
    r = groups.agg(F.sum(n * (rate - above) ** 2).alias("ss"), F.sum(within * rest).alias("noise"), F.sum(n * rest).alias("free"), (F.sum(n * within) / F.sum(n)).alias("within")).first()
    if not r["free"] or not r["within"]:
        return 1e6
    between = max((r["ss"] - r["noise"]) / r["free"], r["within"] * 1e-6)
    return float(min(max(r["within"] / between - 1, 1.0), 1e6))


def score_documents(docs: DataFrame, models: tuple[Model, ...]) -> DataFrame:
    """doc_id, host, path, and for each target its logit (``z_``) and probability (``p_``) from the document alone."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(models)
    names = [f"{k}_{t}" for t in TARGETS for k in "zp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        caches = [_Weights(m.weights) for m in own]
        for batch in batches:
            out = []
            for text in texts(batch.column(3)):
                data = text.encode("utf-8", "surrogatepass")
                words = data.split()
                s = style(words, data)
                out.append([min(max(m.logit(words, s, c), -30.0), 30.0) if words else m.prior for m, c in zip(own, caches, strict=True)])
            z = np.array(out, np.float64).reshape(len(out), len(own))
            cols = [x for t in range(len(own)) for x in (pa.array(z[:, t]), pa.array(1 / (1 + np.exp(-z[:, t]))))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *cols], names=["doc_id", "host", "path", *names])

    return docs.select("doc_id", "host", "path", "text").mapInArrow(run, "doc_id long, host string, path string, " + ", ".join(f"{n} double" for n in names))


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, quality_score, toxic_score, site_quality, kept for every row of ``docs``.

    ``host`` and ``path`` name a document's site and section: here its source, and its source and language, as the
    table has no addresses. Nulls are groups of their own. kept: quality at least ``threshold`` and toxic below it. A
    null or empty text, or one without words, has only its site's rate. Texts of any length are read whole. Repeated
    rows and rows that share a doc_id are judged each, with the labels of their doc_id if they are sampled. Without
    labels of both kinds a target's score is its prior. Other columns are ignored. An empty table gives an empty result.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    rows = sample(docs, labels)
    models = tuple(train([(r[0], r[k]) for r in rows if r[k] is not None]) for k in (1, 2))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.lit("="), host.cast("string")).alias("host"), F.concat(F.lit("="), path.cast("string")).alias("path"), F.col("text").cast("string").alias("text")).fillna("", ["host", "path"])
    scored = materialise(score_documents(named, models), "scored")
    sums = [F.sum(f"p_{t}").alias(f"s_{t}") for t in TARGETS]
    paths = materialise(scored.groupBy("host", "path").agg(F.count("*").alias("n"), *sums), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n_host"), *(F.sum(f"s_{t}").alias(f"h_{t}") for t in TARGETS))
    overall = paths.agg(F.sum("n").alias("n"), *(F.sum(f"s_{t}").alias(t) for t in TARGETS)).first()
    rates = paths.join(hosts, "host")
    own = scored.join(rates, ["host", "path"])
    logit = lambda p: F.log(p / (1 - p))
    clamp = lambda p: F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    total = F.lit(float(max(1, overall["n"] or 0)))
    for t, m in zip(TARGETS, models, strict=True):
        base = min(max((overall[t] or 0.0) / max(1, overall["n"] or 0), 1e-6), 1 - 1e-6)
        site_rate = F.col(f"h_{t}") / F.col("n_host")
        strong = _strength(hosts, site_rate, F.col("n_host"), F.lit(base), total)
        weak = _strength(rates, F.col(f"s_{t}") / F.col("n"), F.col("n"), site_rate, F.col("n_host"))
        site = clamp((F.col(f"h_{t}") - F.col(f"p_{t}") + strong * F.lit(base)) / (F.col("n_host") - 1 + strong))
        rest = clamp((F.col(f"s_{t}") - F.col(f"p_{t}") + weak * site) / (F.col("n") - 1 + weak))
        z = F.col(f"z_{t}") - m.prior + logit(rest)
        own = own.withColumn(f"site_{t}", rest).withColumn(f"{t}_score", 1 / (1 + F.exp(-z)))
    kept = (F.col("quality_score") >= threshold) & (F.col("toxic_score") < threshold)
    return own.select("doc_id", F.round("quality_score", 6).alias("quality_score"), F.round("toxic_score", 6).alias("toxic_score"), F.round("site_quality", 6).alias("site_quality"), kept.alias("kept"))
