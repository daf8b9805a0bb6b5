"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's
docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faradeon.llm import decontaminate, language_id, line_dedup, near_dup, packing
from faradeon.llm._shared import materialise, packed, read

#: Near-duplicates in the pipeline: five words a shingle, similarity 0.8.
WORDS, PERCENT = 5, 80


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as fields of ``__rest``, where no name meets one of an operator's own."""
    rest = [F.col(f"`{c}`").alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(rest or [F.lit(None).alias("none")])).alias("__rest"))


def _own(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of ``docs`` out of rows like those of ``_carried``, but for those that are ``changed``."""
    return [changed.get(c, F.col(c) if c in ("doc_id", "text") else F.col("__rest").getField(c)).alias(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language ('und': null, empty or without a letter) go; lang becomes the predicted one, if any could be learned.

    Each row is judged by its own text, of any length; equal texts, and so repeated rows, stay or go together, and of
    equal code lengths the first language by name is taken. Null ids and null langs are kept. All other columns pass with
    their values, whatever their names. An empty table gives an empty one.
    """
    found = language_id.identify(_carried(docs), language_id.train(language_id.sample(docs)))
    kept = found.where(F.col("lang_pred").isNull() | (F.col("lang_pred") != language_id.UNDETERMINED))
    return kept.select(*_own(docs, lang=F.coalesce("lang_pred", F.col("__rest").getField("lang"))))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; documents of which no text is left go with them. n_chars follows the text.

    Null and empty texts, which have no lines to lose, stay; so does the first document of each template. Rows that share a doc_id, a null
    one too, are one document. All other columns pass with their values, whatever their names. An empty table gives an empty one.
    """
    left = line_dedup.drop_recurring_lines(_carried(docs)).where((F.col("lines_dropped") == 0) | (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return left.select(*_own(docs, n_chars=F.length("text").cast("long")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the one with the least doc_id, null first, then the least text by its hash.

    Every row is a document of its own, whatever rows share its doc_id; rows without words all stay.
    """
    # a number for each row, fixed by writing it: doc_id may be null or shared
    rows = packed(docs).select("__id", "__row", F.xxhash64("__row.text").alias("__order"), F.monotonically_increasing_id().alias("__key"))
    rows = materialise(rows, "rows")
    found = near_dup.near_duplicates(rows.select("__key", F.col("__row.text").alias("__text")), WORDS, PERCENT, "__key", "__text").select(F.col("doc_id").alias("__key"), F.col("component_id").alias("__group"))
    found = materialise(found, "groups")
    # groups of two rows or more; minima combine before the shuffle
    many = found.groupBy("__group").agg(F.count("*").alias("n")).where("n > 1").select("__group")
    members = found.join(many, "__group").join(rows.select("__key", "__id", "__order"), "__key").select("__group", "__key", F.struct("__id", "__order", "__key").alias("at"))
    stays = members.groupBy("__group").agg(F.min("at").alias("first"))
    gone = materialise(members.join(stays, "__group").where("at > first").select("__key"), "near-duplicates")
    return rows.join(gone, "__key", "left_anti").select("__row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go, each row by its own text; null and empty texts stay.

    Repeated rows stay or go together, ties play no part, and texts of any length are read whole. All columns pass with their values, whatever
    their names. An empty table, or an empty benchmark, takes nothing away.
    """
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 1024 tokens.

    Null and empty texts are documents of the end id alone; rows that share a doc_id, and repeated rows, are packed each. Columns other
    than doc_id and text are ignored. An empty table gives no rows.
    """
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: Language ID, near-dedup and tokenising have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
