"""Line dedup by a log-template tree, in DataFrame functions only.

A line's path in the tree is its count of tokens and its leading tokens, tokens with digits generalised to
``<*>``. In the leaf, a line stands for its exact template and for the templates in which one of ``BLOCKS`` equal
runs of the remaining tokens is a variable field, where there are as many tokens. Two lines share a template exactly
if they differ in variable fields or within one run only, so recurring templates are found by grouping, without
comparing lines. Lines of a template that recurs across documents are dropped from all but the first of them.

Tokens are separated by spaces, tabs or carriage returns; longer runs of other characters than ``LONG`` are cut, so
that lines of scripts without spaces have tokens too. An exact template (tokens with digits as fields) recurs if
``SUPPORT`` documents hold it, whatever its length, as long as it has a fixed token. A template with a variable run must also be
held by so many that documents times fixed tokens reach ``EVIDENCE``, as such templates of few fixed tokens coincide by
chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialise, packed

#: Leading tokens in a line's path.
LEAD = 2
BLOCKS = 5
#: Characters of a token at most.
LONG = 16
#: Documents in which a template must recur, and the least product of documents and fixed tokens of one with a variable run.
SUPPORT = 2
EVIDENCE = 16


def _tokens(plain: Column) -> Column:
    masked = F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(plain)
    return F.split(F.when(masked.rlike(f"[^ ]{{{LONG}}}"), F.regexp_replace(masked, f"([^ ]{{{LONG}}})", "$1 ")).otherwise(masked), " ", -1)


def line_templates(docs: DataFrame, lead: int = LEAD, blocks: int = BLOCKS) -> DataFrame:
    """__id, line (hash) and templates (array of key, fixed tokens, exact or not) of the distinct lines of each row that aren't blank; ``docs``: __id, text."""
    lines = docs.select("__id", F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("l"))
    plain = F.when(F.contains("l", F.lit("\t")) | F.contains("l", F.lit("\r")), F.translate("l", "\t\r", "  ")).otherwise(F.col("l"))
    lines = lines.select("__id", "l", plain.alias("plain")).where(F.trim("plain") != "")
    split = lines.select("__id", F.xxhash64("l").alias("line"), _tokens(F.col("plain")).alias("t")).withColumn("n", F.size("t"))
    fixed = lambda tokens: F.size(F.array_remove(tokens, "<*>"))
    at = [F.floor(F.greatest(F.col("n") - lead, F.lit(0)) * j / F.lit(float(blocks))).cast("int") for j in range(blocks + 1)]
    runs = split.select("__id", "line", "n", F.xxhash64("n", F.slice("t", 1, lead)).alias("head"), fixed(F.col("t")).alias("f"), *(F.slice("t", at[j] + lead + 1, at[j + 1] - at[j]).alias(f"r{j}") for j in range(blocks)))
    hashed = runs.select("__id", "line", "n", "head", "f", *(F.xxhash64(f"r{j}").alias(f"h{j}") for j in range(blocks)), *(fixed(F.col(f"r{j}")).alias(f"f{j}") for j in range(blocks)))
    key = lambda wild: F.xxhash64(F.lit(wild), "head", *(F.lit(0).cast("long") if j == wild else F.col(f"h{j}") for j in range(blocks)))
    template = lambda wild: F.struct(key(wild).alias("key"), (F.col("f") - (F.col(f"f{wild}") if wild >= 0 else 0)).alias("fixed"), F.lit(wild < 0).alias("exact"))
    all_ = F.array(*(template(j) for j in range(-1, blocks)))
    return hashed.select("__id", "line", F.when(F.col("n") >= lead + blocks, all_).otherwise(F.array(template(-1))).alias("templates"))


def drop_recurring_lines(docs: DataFrame, support: int = SUPPORT, evidence: int = EVIDENCE, keep_first: bool = True) -> DataFrame:
    """``docs`` with lines of recurring templates taken out of ``text``, and lines_dropped (long).

    An exact template recurs if ``support`` documents hold it, two at least; one with a variable run if moreover their
    count times its fixed tokens is ``evidence`` or more. The document with the least doc_id keeps its lines of it (``keep_first``), all others lose
    theirs. Repeated lines within one document alone stay, and so do blank lines. Null text stays null, empty text
    empty; lines of any length are read whole. Rows that share a doc_id count as one document; a null doc_id counts as the least. Templates without fixed tokens never recur. All columns are kept (a lines_dropped of
    the input's own is replaced); an empty table gives an empty result.
    """
    rows, whole = packed(docs), F.col("__row.text")
    # stored once, as hashes: both the groups and the lines that meet them are read from it
    lines = materialise(line_templates(rows.select("__id", whole.alias("text"))), "line-templates").select("__id", "line", F.explode("templates").alias("t")).select("__id", "line", "t.key", "t.fixed", "t.exact")
    support = max(support, 2)
    # documents that a template needs; none is enough for one without fixed tokens
    need = F.when(F.col("exact"), F.lit(support)).otherwise(F.greatest(F.lit(support), F.ceil(F.lit(evidence) / F.col("fixed")).cast("int")))
    lines = lines.where("fixed > 0").select("__id", "line", "key", need.alias("need"))
    # minima, maxima and counts combine before the shuffle: a template in a third of all lines is a row a task
    groups = lines.groupBy("key").agg(F.min("__id").alias("first"), F.max("__id").alias("last"), F.count("*").alias("n"), F.max("need").alias("need"))
    # lines are no fewer than documents: of the templates with enough lines, documents are counted
    some = groups.where((F.col("first") < F.col("last")) & (F.col("n") >= F.col("need"))).select("key", "first", "need")
    hits = materialise(lines.select("__id", "line", "key").join(some, "key"), "line-hits")
    sure = F.col("need") <= 2  # least and last are two documents
    counted = hits.where(~sure).select("key", "__id", "need").distinct().groupBy("key").agg(F.count("*").alias("documents"), F.max("need").alias("need")).where(F.col("documents") >= F.col("need")).select("key")
    hits = hits.where(sure).unionByName(hits.where(~sure).join(counted, "key").select(*hits.columns))
    if keep_first:
        hits = hits.where(F.col("__id") > F.col("first"))
    dropped = materialise(hits.groupBy("__id").agg(F.collect_set("line").alias("__drop")), "dropped-lines")
    all_lines = F.split(whole, "\n", -1)
    some = F.col("__drop").isNotNull() & whole.isNotNull()
    out = rows.join(dropped, "__id", "left").withColumn("__left", F.when(some, F.filter(all_lines, lambda x: ~F.array_contains("__drop", F.xxhash64(x)))))
    lost = F.when(some, F.size(all_lines) - F.size("__left")).otherwise(0).cast("long")
    text = F.when(some, F.array_join("__left", "\n")).otherwise(whole)
    return out.select(*((text if c == "text" else F.col("__row").getField(c)).alias(c) for c in docs.columns if c != "lines_dropped"), lost.alias("lines_dropped"))
